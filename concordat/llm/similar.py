"""Similar documents: every pair from a Jaccard similarity on, by an exact prefix-filtered join of word shingles.

Equal texts are one class, told by a hash; shingles do not mind case and blanks.  A class is the set of its shingles in one order that
all classes share: frequent shingles of a bounded sample last, the others by hash.  Two sets of similarity ``s`` share
a shingle among the first ``n - ceil(s n) + 1`` of each, whatever the order is, so that the sample bears on cost and never on results.
Classes that share such a shingle, and whose sizes and places there allow ``s``, are candidates; each is confirmed by the exact
similarity of its two sets.

Pairs that the caller names, such as those of near fingerprints, are confirmed first and the similar ones united.
A large group of near copies is not compared as all pairs: in ``ROUNDS`` rounds each class meets one or two pivots of its
shingles' groups, the class of the group with most links so far and one by hash, and the confirmed ones are united; then every candidate pair that is still in two components is tried.  Those are paired with the parities of their sets at hand: bit i is the parity
of the shingles that fall on i, so that two sets differ in at least as many shingles as their parities do in bits.  Pairs that differ too much by
that are no candidates, and no similar pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.operators.graph import components, counted, cut

#: Documents that the order of shingles is learned from, the least number of them that makes a shingle frequent, and the most kept.
SAMPLE, FREQUENT, KEPT = 20_000, 2, 1 << 18
#: Classes wanted again, and candidate pairs, are told by a broadcast up to so many.
BROADCAST_ROWS = 500_000
#: Rounds of pivots before all remaining candidates.
ROUNDS = 1
#: Classes of a group that one block holds, rows that a task takes, and candidate pairs looked at at a time.
BLOCK, BATCH, PAIRS = 2048, 50_000, 1 << 20
#: Bits of parity for each shingle, and the most of a class: of larger sets fewer pairs are told apart early.
BITS, MOST_BITS = 3, 4096
SLACK = 1e-9


def class_of(text: Column) -> Column:
    """The class of a text, as ``shingle_set`` has it: a hash of the text; zero for a wordless one."""
    return F.when(text.rlike("[^ \\t-\\r]"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def shingle_set(text: str | None, width: int, known: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """(class, sorted hashes of the distinct shingles); a text under ``width`` words is one shingle, a wordless one has class zero and none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return 0, np.zeros(0, np.uint64)
    if len(known) > 1 << 16:
        known.clear()
    digest = xxhash.xxh64_intdigest
    for w in words:
        if w not in known:
            known[w] = digest(w, 42)
    hashes = np.array([known[w] for w in words], np.uint64)
    k = min(width, len(words))
    mixed = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        mixed = (mixed ^ hashes[j : j + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return int.from_bytes(digest(raw, 42).to_bytes(8, "little"), "little", signed=True), np.unique(mixed)


def prefix(shingles: np.ndarray, similarity: float, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """(the first shingles of a set in the shared order, as many as a similar set cannot all lack; how many of them are not frequent and come first)."""
    n = len(shingles)
    late = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        late = np.where(frequent[at] == shingles, rank[at], 0)
    first = np.lexsort((shingles, late))[: n - math.ceil(similarity * n - SLACK) + 1 if n else 0]
    return shingles[first], int(np.count_nonzero(late[first] == 0))


def parity(shingles: np.ndarray) -> bytes:
    """The parities of the shingles that fall on each bit; the number of bits is a power of two, and halves that are xored are the parities on half as many."""
    width = min(MOST_BITS, max(64, 1 << (BITS * len(shingles)).bit_length()))
    return np.packbits(np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def least_difference(parities: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of places in parities (bytes), a number that the shingles in which the two sets differ do not fall below."""
    words = np.array([len(x) // 8 for x in parities])
    least, result = np.minimum(words[a], words[b]), np.zeros(len(a), np.int64)
    for width in np.unique(least).tolist():
        pairs = np.flatnonzero(least == width)
        used, at = np.unique(np.r_[a[pairs], b[pairs]], return_inverse=True)
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(parities[k], np.uint64).reshape(-1, width), 0) for k in used])
        for i in range(0, len(pairs), 1 << 16):
            x, y = (at[lo + i : min(lo + i + (1 << 16), lo + len(pairs))] for lo in (0, len(pairs)))
            result[pairs[i : i + (1 << 16)]] = np.bitwise_count(bits[x] ^ bits[y]).sum(1)
    return result


def frequent_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sorted; their rank by documents of the sample), at most ``KEPT``."""
    n = texts.count()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), width, known)[1].view(np.int64))], ["g"])

    # exact copies fall on the same side of the hash; what they add to the counts bears on the order alone
    part = texts.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    counted = part.mapInArrow(shingled, "g long").groupBy("g").count().where(F.col("count") >= FREQUENT)
    rows = counted.orderBy(F.desc("count"), "g").limit(KEPT).toArrow()
    shingles = rows.column("g").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows.column("count").to_numpy()[order]


def _may(similarity: float, n, p, m, q, least):
    """Whether sets of n and m shingles that share those at places p and q can be similar: least is min for the kind of n."""
    return (least(n, m) >= similarity * (n + m - least(n, m)) - SLACK) & ((1 + least(n - p, m - q) - 1) * (1 + similarity) >= similarity * (n + m) - SLACK)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _sets(classes: DataFrame, rows: int, texts: DataFrame, width: int, made: Callable[[np.ndarray], bytes], small: bool) -> DataFrame:
    """(cls, made): what is made of the shingle sets of classes, which may be repeated in their rows.  Only texts of those are read again; what is small is moved in their stead."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            rows = [shingle_set(x.as_py(), width, known) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([made(r[1]) for r in rows], pa.binary())], ["cls", "made"])

    wanted = texts.select(class_of(F.col("text")).alias("cls"), "text").join(_small(classes, rows), "cls", "left_semi")
    once = wanted if small else wanted.dropDuplicates(["cls"])
    sets = once.select("text").mapInArrow(whole, "cls long, made binary")
    return sets.dropDuplicates(["cls"]) if small else cut(sets)


def _confirmed(pairs: DataFrame, rows: int, texts: DataFrame, width: int, similarity: float) -> tuple[DataFrame, int]:
    """The pairs (a, b) whose sets are similar, and how many; pairs and texts are materialised."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("cls")), 2 * rows, texts, width, np.ndarray.tobytes, small=False)
    x, y = (sets.select(F.col("cls").alias(k), F.col("made").alias(f"_{k}")) for k in "ab")
    return counted(x.join(_small(pairs, rows), "a").join(y, "b").select("a", "b", "_a", "_b").mapInArrow(compared, "a long, b long"))


def _pivots(places: DataFrame, similarity: float, seed: int) -> DataFrame:
    """(a, b): each class with two of its shingles' groups: the one of most links, the first in an order among equals, and the last in that order.

    The order is that of the classes, which are hashes, with some bits turned by the seed.
    """
    turned = F.lit(seed * 0x5DEECE66D5DEECE6)
    ends = (F.struct(first.alias("links"), F.col("cls").bitwiseXOR(turned).alias("h"), "n", "p", "component") for first in (-F.col("links"), F.lit(0).cast("long")))
    pivots = places.groupBy("g").agg(F.min(next(ends)).alias("x"), F.max(next(ends)).alias("y")).select("g", F.array("x", "y").alias("z"))
    met = places.join(pivots, "g").select("cls", "n", "p", "component", F.explode("z").alias("z")).withColumn("other", F.col("z.h").bitwiseXOR(turned))
    may = _may(similarity, F.col("n"), F.col("p"), F.col("z.n"), F.col("z.p"), F.least)
    return met.where((F.col("component") != F.col("z.component")) & may).select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def _all(places: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): every candidate pair in two components that may be similar by its parities; groups over ``BLOCK`` are dealt into blocks, and every two blocks meet in a task."""
    sizes = places.groupBy("g").agg(F.count("*").alias("count"), F.min("component").alias("least"), F.max("component").alias("most"))
    blocks: Column = F.ceil(F.col("count") / BLOCK)
    open_places, rows = counted(places.join(sizes.where("least != most").select("g", blocks.alias("blocks")), "g").select("cls", "n", "p", "component", "g", "blocks"))
    parities = _sets(open_places.select("cls"), rows, texts, width, parity, small=True).withColumnRenamed("made", "parity")
    met = (
        open_places.join(parities, "cls")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cls", "n", "p", "component", "parity", F.xxhash64("g", F.least("block", "other"), F.greatest("block", "other")).alias("g"))
    )
    batches = max(1, math.ceil(rows / BATCH))

    def paired(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g", kind="stable")
        g, cls, n, p, c = (rows[k].to_numpy() for k in ("g", "cls", "n", "p", "component"))
        parities = rows["parity"].to_numpy()
        edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
        found = [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            step = max(1, PAIRS // (hi - lo))
            for i in range(lo, hi, step):
                x, y = slice(i, min(i + step, hi)), slice(lo, hi)
                near = (cls[x, None] < cls[None, y]) & (c[x, None] != c[None, y]) & _may(similarity, n[x, None], p[x, None], n[None, y], p[None, y], np.minimum)
                a, b = (at + lo for at, lo in zip(np.nonzero(near), (i, lo), strict=True))
                if len(a):
                    alike = least_difference(parities[y], a - lo, b - lo) * (1 + similarity) <= (1 - similarity) * (n[a] + n[b]) + SLACK
                    found.append(np.stack([cls[a[alike]], cls[b[alike]]], 1))
        every = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": every[:, 0], "b": every[:, 1]})

    return met.groupBy(F.pmod("g", F.lit(batches)).alias("batch")).applyInPandas(paired, "a long, b long").distinct()


def _found(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, component, links) of the classes that have links, and how many classes those are."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    return counted(components(links).join(degree, "node"))


def similar_groups(docs: DataFrame, key: str, text: str, width: int, similarity: float, likely: DataFrame) -> DataFrame:
    """(key, t, group) for every row of docs: its text's hash, and the least class that pairs of at least ``similarity`` reach.

    ``likely`` has pairs (a, b) of classes that are confirmed before any others are looked for.  Wordless texts are one class.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    frequent, rank = frequent_shingles(texts, width)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for x in batch.column(0):
                cls, shingles = shingle_set(x.as_py(), width, known)
                first, rare = prefix(shingles, similarity, frequent, rank)
                rows.append((cls, len(shingles), first.view(np.int64), rare))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "n", "prefix", "rare"])

    prefixes = cut(texts.select("text").mapInArrow(begun, "cls long, n int, prefix array<long>, rare int"))
    every = prefixes.select("cls", "n", "rare", F.posexplode("prefix").alias("p", "g"))
    # frequent shingles are shared as it is, so that no group that the sample has met is gathered here, however hot;
    # the others are moved once, and those of a single class leave
    group = W.partitionBy("g")
    rare = every.where("p < rare").select("cls", "n", "p", "g", F.min("cls").over(group).alias("least"), F.max("cls").over(group).alias("most"))
    often = every.where("p >= rare").select("cls", "n", "p", "g").distinct()
    shared = cut(rare.where("least != most").select("cls", "n", "p", "g").distinct().union(often))
    pairs, n = counted(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    tried, (links, _) = pairs, _confirmed(pairs, n, texts, width, similarity)
    found, nodes = _found(links)
    for turn in range(ROUNDS + 1):
        places = shared.join(_small(found, nodes).withColumnRenamed("node", "cls"), "cls", "left")
        places = places.withColumns({"component": F.coalesce("component", "cls"), "links": F.coalesce("links", F.lit(0))})
        new = _pivots(places, similarity, turn) if turn < ROUNDS else _all(places, texts, width, similarity)
        pairs, n = counted(new.join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        new, n = _confirmed(pairs, n, texts, width, similarity)
        if n:
            links = links.union(new)
            found, nodes = _found(links)
    every_row = texts.select("key", F.xxhash64("text").alias("t"), class_of(F.col("text")).alias("cls"))
    return every_row.join(_small(found, nodes).withColumnRenamed("node", "cls"), "cls", "left").select("key", "t", F.coalesce("component", "cls").alias("group"))
