"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the tokenizer's pattern.  The ranked merges are a fold of Spark higher-order
functions over the byte arrays of *distinct* pieces: the state is a piece's parts and the ranks of its adjacent pairs, and each step
joins the first pair of the lowest rank and looks up the two pairs that this changes in a literal rank map, which
stands in the plan once.  The frequent distinct pieces are merged so, as a table of at most ``cache_pieces`` short pieces, and
broadcast.  A rarer piece is merged where it stands, by the same fold over arrays (``merge_pieces``): most rare pieces
occur once, so that a table of them would have to be joined back to nearly as many rows as it has (see README).  So no
text is ever shuffled and what is broadcast has a fixed bound.  Decoding concatenates the binary pieces of the ids.

Defined results: a null or empty text has no ids; ids never include special tokens; extra
columns of the input are kept unless they clash with a result's name, in which case the
result wins; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import without
from concordat.llm.subwords import chunks
from concordat.operators.graph import cut

#: Slots of the literal rank map; about one key in each.
SLOTS = 1 << 16
#: Longest piece, in bytes, that the cache takes.
CACHE_BYTES = 48
#: Text, in bytes, that a task cuts up at a time; of a longer text, so many pieces at a time.
PART_BYTES, PART_PIECES = 1 << 20, 1 << 17
#: Pieces that a task remembers beside the cache.
REMEMBERED = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file has a line for each token: base64 of its bytes, and its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """array<map<hex, id>>: a literal map, dealt into slots by the key's hash so that a look-up is constant time."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for token, rank in ranks.items():
        name = token.hex().upper()
        slots[xxhash.xxh64_intdigest(name.encode(), seed=42) % SLOTS][name] = rank
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,int>>")


def rank_of(table: Column, token: Column) -> Column:
    # SLOTS is a power of two, so the low bits of the signed hash are its remainder
    name = F.hex(token)
    return F.get(table, F.xxhash64(name).bitwiseAND(F.lit(SLOTS - 1)).cast("int"))[name]


def merged(piece: Column, ranks: dict[bytes, int]) -> Column:
    """array<int>: the ids of one piece."""

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def folded(table: Column) -> Column:
        def pair_rank(a: Column, b: Column) -> Column:
            return F.when(a.isNotNull() & b.isNotNull(), rank_of(table, F.concat(a, b)))

        def step(state: Column, _: Column) -> Column:
            parts, pairs = state["parts"], state["pairs"]

            def joined(at: Column) -> Column:
                """The state with parts at and at + 1, counted from 1, made one."""
                both = F.concat(F.get(parts, at - 1), F.get(parts, at))
                before = F.when(at > 1, F.array(pair_rank(F.get(parts, at - 2), both))).otherwise(F.array().cast("array<int>"))
                after = F.when(at < F.size(pairs), F.array(pair_rank(both, F.get(parts, at + 1)))).otherwise(F.array().cast("array<int>"))
                return F.struct(
                    F.concat(F.slice(parts, 1, at - 1), F.array(both), F.slice(parts, at + 2, F.size(parts))).alias("parts"),
                    F.concat(F.slice(pairs, 1, F.greatest(at - 2, F.lit(0))), before, after, F.slice(pairs, at + 2, F.size(parts))).alias("pairs"),
                )

            best = F.array_min(pairs)
            return F.when(best.isNotNull(), let(F.array_position(pairs, best).cast("int"), joined)).otherwise(state)

        raw = F.encode(piece, "UTF-8")
        size = F.octet_length(raw)
        parts = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(raw, i, F.lit(1)))
        pairs = F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: rank_of(table, F.substring(raw, i, F.lit(2))))).otherwise(F.array().cast("array<int>"))
        whole = rank_of(table, raw)
        fold = F.aggregate(
            F.sequence(F.lit(1), size),
            F.struct(parts.alias("parts"), pairs.alias("pairs")),
            step,
            lambda state: F.transform(state["parts"], lambda p: rank_of(table, p)),
        )
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(fold)

    return let(rank_map(ranks), folded)


def cut_up(text: str | None, pattern: regex.Pattern) -> Iterator[list[str]]:
    """The text's pieces in order; a long text's in several lists."""
    if not text:
        return
    if len(text) <= PART_BYTES:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while part := [m[0] for m in islice(found, PART_PIECES)]:
        yield part


def frequent_pieces(docs: DataFrame, pattern: str, text: str, most: int) -> DataFrame:
    """(piece, n): the pieces of at most CACHE_BYTES bytes that occur most often: all from the least count on that leaves no more than ``most``."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, counts = regex.compile(pattern), Counter()

        def told() -> pa.RecordBatch:
            short = {p: n for p, n in counts.items() if len(p.encode()) <= CACHE_BYTES}
            return pa.RecordBatch.from_arrays([pa.array(short.keys(), pa.string()), pa.array(short.values(), pa.int64())], ["piece", "n"])

        for batch in batches:
            for value in batch.column(0):
                for part in cut_up(value.as_py(), compiled):
                    counts.update(part)
                if len(counts) > PART_PIECES:
                    yield told()
                    counts.clear()
        yield told()

    counts = cut(docs.select(text).mapInArrow(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1"))
    size = F.floor(4 * F.log2("n")).cast("int")  # at most some hundreds of sizes
    left, least = most, None
    for row in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        if row["count"] > left:
            break
        left, least = left - row["count"], row["size"]
    return counts.where(size >= least) if least is not None else counts.limit(0)


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys left << 32 | right of every two tokens that make a third, and its id."""
    keys, made = array("q"), array("q")
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                made.append(rank)
    order = np.argsort(keys)
    return np.array(keys, np.int64)[order], np.array(made, np.int64)[order]


def merge_pieces(pieces: list[bytes], ranks: dict[bytes, int], keys: np.ndarray, made: np.ndarray) -> list[bytes]:
    """The ids of each piece as little-endian 32-bit integers.

    All pieces take a step together: the lowest rank of each, at all its places that do not overlap.
    """
    out: list[bytes] = [b""] * len(pieces)
    single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
    ids = single[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    none = np.int64(1) << 40
    while len(ids):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        key = ids << 32 | np.r_[ids[1:], 0]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank = np.where(keys[at] == key, made[at], none)
        rank[np.r_[first[1:] - 1, len(ids) - 1]] = none
        best = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.r_[first, len(ids)])
        over = best == none
        for k in np.flatnonzero(over):
            out[owner[first[k]]] = ids[first[k] : first[k] + sizes[k]].astype("<u4").tobytes()
        hit = np.flatnonzero((rank == np.repeat(best, sizes)) & (rank < none))
        if len(hit):
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            ids[hit] = rank[hit]
        keep = ~np.repeat(over, sizes)
        keep[hit + 1] = False
        ids, owner = ids[keep], owner[keep]
    return out


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", cache_pieces: int = 1 << 17, keep_text: bool = True
) -> DataFrame:
    """Adds ``ids``: the text's token ids, packed as little-endian unsigned 32-bit integers; keep_text: whether the text stays beside them."""
    context = docs.sparkSession.sparkContext
    ranks = read_ranks(ranks_path)
    frequent = frequent_pieces(docs, pattern, text, cache_pieces).repartition(context.defaultParallelism)
    table = frequent.select("piece", merged(F.col("piece"), ranks).alias("ids")).toArrow()  # at most cache_pieces short rows
    packed = (np.asarray(v.values).astype("<u4").tobytes() for v in table.column("ids"))
    shared = context.broadcast((dict(zip(table.column("piece").to_pylist(), packed, strict=True)), ranks, *pair_table(ranks)))

    kept = [c for c in without(docs, ids) if c != text]
    kept += [text] if keep_text and text in without(docs, ids) else []
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids, T.BinaryType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached, ranks, keys, made = shared.value
        compiled, known = regex.compile(pattern), dict(cached)

        def code(lists: list[list[str]]) -> list[bytes]:
            """The ids of each list of pieces."""
            new = list(set().union(*lists).difference(known))
            raw = [p.encode() for p in new]
            found = [ranks[b].to_bytes(4, "little") if b in ranks else None for b in raw]
            rest = iter(merge_pieces([b for b, f in zip(raw, found, strict=True) if f is None], ranks, keys, made))
            known.update(zip(new, (next(rest) if f is None else f for f in found), strict=True))
            out = [b"".join(map(known.__getitem__, pieces)) for pieces in lists]
            if len(known) > len(cached) + REMEMBERED:
                known.clear()
                known.update(cached)
            for p, b in zip(new, raw, strict=True):
                if len(b) > CACHE_BYTES:
                    known.pop(p, None)
            return out

        for batch in (part for whole in batches for part in chunks(whole, whole.num_columns - 1, PART_BYTES)):
            lists, owner = [], []
            parts: list[list[bytes]] = [[] for _ in range(batch.num_rows)]

            def flush() -> None:
                for k, coded_part in zip(owner, code(lists), strict=True):
                    parts[k].append(coded_part)
                lists.clear()
                owner.clear()

            for k, value in enumerate(batch.column(batch.num_columns - 1)):
                for pieces in cut_up(value.as_py(), compiled):
                    lists.append(pieces)
                    owner.append(k)
                    if len(pieces) == PART_PIECES:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(map(b"".join, parts), pa.binary())], [*kept, ids])

    # the text comes last, and as itself where it is last in the result too
    shared_text = bool(kept) and kept[-1] == text
    passed = [*map(F.col, kept), *([] if shared_text else [F.col(text)])]
    return docs.select(*passed).mapInArrow(coded, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the binary pieces of the packed ids, concatenated.  Null ids give null; an unknown id fails."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = without(df, decoded)
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(decoded, T.BinaryType())])
    at = kept.index(ids)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {rank: token for token, rank in shared.value.items()}
        for batch in (part for whole in batches for part in chunks(whole, at, PART_BYTES)):
            out = []
            for value in batch.column(at):
                value = value.as_py()
                try:
                    out.append(None if value is None else b"".join(map(piece.__getitem__, np.frombuffer(value, "<u4").tolist())))
                except KeyError as unknown:
                    raise ValueError(f"no such token: {unknown}") from None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], schema.names)

    return df.select(*kept).mapInArrow(joined, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, path, public_tokenizers.PATTERN, keep_text=False)
    return decode(coded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
