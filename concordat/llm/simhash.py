"""Near-duplicate documents: SimHash fingerprints linked by a binary trie self-join.

Equal fingerprints are collapsed before anything is joined, so a group of exact copies counts
once.  Two fingerprints within ``budget`` bits agree on at least ``r`` of ``budget + r`` bit ranges; the
ranges deal the fingerprints out to Spark's tasks (every choice of ``r`` ranges is a group key) and
``r`` follows the number of fingerprints so that groups stay small at any size.  A group
too large for one task is dealt into blocks, and every two blocks meet in a task of their own.  In a
task the binary tries of its groups are traversed together: a pair of nodes carries the bits
that differ so far and is dropped once they exceed the budget.  Of the links found in a task only a spanning forest leaves it, and
the components of all links are found by distributed star contraction.

Defined results: null, empty and wordless texts have the fingerprint zero and are linked like any other; texts of fewer words than a
shingle are one shingle, long ones are taken whole; rows that repeat a key have a row of the result each; an empty table gives an
empty result.  ``near_duplicates`` returns its own columns only and ``first_of_each`` those of the input, whatever the others are called.

Where an exact similarity decides (``first_of_each``), fingerprints that agree on some of a fixed number of ranges and differ in at most ``WIDE`` bits name
the first candidates; what they miss at that similarity is left to ``similar``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from concordat.llm.common import unused, without
from concordat.llm.similar import class_of, similar_groups
from concordat.operators.graph import BROADCAST_ROWS, components, cut

#: Fingerprints of a group that one block holds.
BLOCK = 2048
#: Rows that a task traverses at a time.
BATCH = 20_000
#: Node pairs that a traversal holds at a time.
FRONTIER = 1 << 20
#: Bits that fingerprints of similar documents may differ in, and the bit ranges that deal them out, where an exact similarity decides.
WIDE, WIDE_RANGES = 10, 8


def fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash over shingles of ``width`` words, repeats included; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(width, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], 42) for i, j in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4, name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a long; null and wordless texts have zero."""
    kept = without(docs, name)
    passed = [c for c in kept if c != text]
    schema = T.StructType([*(docs.schema[c] for c in passed), T.StructField(name, T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(t.as_py(), width) for t in batch.column(len(passed))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], schema.names)

    return docs.select(*passed, text).mapInArrow(hashed, schema)


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label after uniting a's and b's sets; label is flat before and after."""
    while len(a):
        x, y = label[a], label[b]
        far = x != y
        a, b, x, y = a[far], b[far], x[far], y[far]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def trie_links(group: np.ndarray, bits: np.ndarray, budget: int) -> np.ndarray:
    """For rows sorted by (group, bits): the first row of each row's set under links within a group.

    The binary tries of all groups are traversed level by level as pairs of nodes; a node is a range of rows.
    """
    label = np.arange(len(bits))
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lo, hi = edge, np.r_[edge[1:], len(bits)]
    todo = [(63, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    while todo:
        bit, pairs = todo.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            todo += [(bit, pairs[:, :half]), (bit, pairs[:, half:])]
            continue
        al, ah, bl, bh, err = pairs
        # two single rows are compared at once; under a node pair with no more levels than spare errors all are linked
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            x, y = al[single], bl[single]
            near = (x != y) & (np.bitwise_count(bits[x] ^ bits[y]) <= budget)
            label = _join_labels(label, x[near], y[near])
        rest = ~single
        full = rest & (err + bit + 1 <= budget)
        for p in np.flatnonzero(full):
            rows = np.r_[al[p] : ah[p], bl[p] : bh[p]]
            label = _join_labels(label, np.full(len(rows), rows[0]), rows)
        al, ah, bl, bh, err = pairs[:, rest & ~full]
        if not len(al):
            continue
        ones = np.r_[0, np.cumsum((bits >> np.uint64(bit) & np.uint64(1)).astype(np.int64))]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = al == bl
        children = [
            np.stack([al, am, bl, bm, err]),
            np.stack([am, ah, bm, bh, err]),
            np.stack([al, am, bm, bh, err + 1]),
            np.stack([am, ah, bl, bm, err + 1])[:, ~same],
        ]
        grown = np.concatenate(children, axis=1)
        grown = grown[:, (grown[0] < grown[1]) & (grown[2] < grown[3]) & (grown[4] <= budget)]
        # a row paired with itself only is done
        grown = grown[:, ~((grown[0] == grown[2]) & (grown[1] - grown[0] == 1))]
        if grown.shape[1]:
            todo.append((bit - 1, grown))
    return label


def _choice(n: int, budget: int, ranges: int | None = None) -> int:
    """How many of the bit ranges a group shares, so that a group has about a hundred fingerprints of n."""
    return next(r for r in range(1, 5) if r == 4 or n / 2 ** (64 * r / (ranges or budget + r)) <= 128)


def links(prints: DataFrame, budget: int = 4, column: str = "fingerprint", ranges: int | None = None) -> DataFrame:
    """(a, b): links that connect every two of the distinct fingerprints within ``budget`` bits, by a spanning forest.

    With ``ranges``, there are so many whatever the budget is, and only those meet that agree on enough of them.
    """
    n = prints.count()
    r = _choice(n, budget, ranges)
    cuts = ranges or budget + r
    edges = [round(64 * i / cuts) for i in range(cuts + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(cuts)]
    masks = [sum(c) for c in itertools.combinations(parts, r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select(
        F.col(column).alias("fp"), F.posexplode(F.array(*map(F.lit, signed))).alias("choice", "mask")
    ).select("fp", F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask").cast("long"))).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > BLOCK)
    if n * len(masks) <= BLOCK * BROADCAST_ROWS:  # so many large groups at most, and the fingerprints need not move to meet them
        large = F.broadcast(large)
    blocks = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1))
    met = (
        keyed.join(large, "key", "left")
        .select("fp", "key", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).alias("block"))
        .select("fp", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("fp", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("g"))
    )
    batches = max(1, math.ceil(n * len(masks) / BATCH))

    def traversed(rows: pd.DataFrame) -> pd.DataFrame:
        g, fp = rows["g"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, g))
        g, fp = g[order], fp[order]
        first = trie_links(g, fp, budget)
        moved = first != np.arange(len(fp))
        return pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[first[moved]].view(np.int64)})

    return met.groupBy(F.pmod("g", F.lit(batches)).alias("batch")).applyInPandas(traversed, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, budget: int = 4
) -> DataFrame:
    """(key, fingerprint, component): the least key that links of near copies reach, itself included.

    One row for each row of docs, repeated ones too.  Wordless texts share the fingerprint zero.
    """
    marked = cut(fingerprints(docs.select(key, text), text, width))
    distinct = cut(marked.groupBy("fingerprint").agg(F.min(key).alias("least")))
    joined = components(links(distinct, budget))
    groups = distinct.join(joined, distinct["fingerprint"] == joined["node"], "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("group")
    )
    least = groups.groupBy("group").agg(F.min("least").alias("component"))
    return marked.join(groups.join(least, "group").select("fingerprint", "component"), "fingerprint").select(
        key, "fingerprint", "component"
    )


def first_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, budget: int = 4, similarity: float | None = None
) -> DataFrame:
    """The rows of docs that stay: of each group of near copies the one with the least (key, text hash), null keys last, once.

    Near copies are linked by fingerprints within ``budget`` bits or, if ``similarity`` is given, are all pairs of at least that exact similarity:
    fingerprints within ``WIDE`` bits name the pairs that are confirmed first, and an exact join finds those that fingerprints tell apart.
    Rows that share a key, or have none, are as many documents as they have texts.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    groups = similar_groups(rows, "key", "text", width, similarity, likely_pairs(rows, width)) if similarity is not None else _fingerprint_groups(rows, width, budget)
    order = F.struct(F.col("key").isNull().alias("null"), "key", "t")
    row, number = unused(docs, "row"), unused(docs, "turn")
    stay = groups.groupBy("group").agg(F.min(order).alias("s")).select(F.xxhash64("s.null", "s.key", "s.t").alias(row))
    names = docs.columns
    # by one column, so that the join and the window share a shuffle; a row number of at most 1 keeps one row of each group before the shuffle
    turn = F.row_number().over(W.partitionBy(row).orderBy(*(n for n in names if n not in (key, text))))
    return (
        docs.withColumn(row, F.xxhash64(F.col(key).isNull(), F.col(key), F.xxhash64(text)))
        .join(stay, row, "left_semi")
        .withColumn(number, turn)
        .where(F.col(number) == 1)
        .select(*names)
    )


def likely_pairs(rows: DataFrame, width: int, budget: int = WIDE, ranges: int = WIDE_RANGES) -> DataFrame:
    """(a, b): pairs of classes of texts whose fingerprints are linked: equal ones by their least class, others by the trie join's forest."""
    marked = cut(fingerprints(rows.select(class_of(F.col("text")).alias("cls"), "text"), "text", width).distinct())
    least = cut(marked.groupBy("fingerprint").agg(F.min("cls").alias("least")))
    equal = marked.join(least, "fingerprint").select(F.col("least").alias("a"), F.col("cls").alias("b"))
    a, b = (least.select(F.col("fingerprint").alias(f"f{k}"), F.col("least").alias(k)) for k in "ab")
    joined = links(least, budget, ranges=ranges).select(F.col("a").alias("fa"), F.col("b").alias("fb")).distinct()
    return equal.union(joined.join(a, "fa").join(b, "fb").select("a", "b")).where("a != b")


def _fingerprint_groups(rows: DataFrame, width: int, budget: int) -> DataFrame:
    """(key, t, group) for every row: the least fingerprint that links reach."""
    marked = cut(fingerprints(rows, "text", width))
    joined = components(links(cut(marked.select("fingerprint").distinct()), budget))
    return marked.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "key", "t", F.coalesce("component", "fingerprint").alias("group")
    )


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=4, budget=4).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
