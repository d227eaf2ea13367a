"""Document fingerprints by prefix polynomial hashes.

A text's code points are summed as ``code x base^place``, modulo two primes; the running sums answer whether any two
spans are equal by one product each, at any length, and a binary search over them finds the longest common extension of two places. Texts are put
together without reading them again: the sums of what is appended are moved by one product.

A fingerprint is the hash of the whole text and, by the same sums, the hashes of all its spans of ``WIDTH`` code points (``SHORT`` in a short
text), of which the least in each of ``BINS`` ranges is kept.  Two fingerprints are as alike as the share of ranges that agree tells of
the spans: ``2 j / (1 + j)`` for a Jaccard similarity ``j``, so that a text of which a third is replaced is alike by two thirds.
Equal hashes of whole texts are alike by 1.

Defined results: null and empty texts are one text of no code points; ids order texts, null last, and rows of one id by their text, so that repeated rows
follow each other; the one row of a table follows itself; other columns are kept, but for those of the results' names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import unused, without
from concordat.llm.subwords import chunks

#: Primes and bases of the two sums.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 1_315_423_911)
#: Code points of a span, those of a text under four spans, ranges of a fingerprint, and the bits kept of the least hash of each.
WIDTH, SHORT, BINS, BITS = 24, 6, 128, 16
#: Text, in bytes, that a task takes at a time.
PART_BYTES = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_next")


class Powers:
    """base^k, or base^-k, modulo each prime, as far as was asked for."""

    def __init__(self, bases: Sequence[int]):
        self.bases = bases
        self.held = [np.ones(1, np.int64) for _ in PRIMES]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.held[0]) <= n:
            self.held = [np.r_[h, h * pow(b, len(h), p) % p] for h, b, p in zip(self.held, self.bases, PRIMES, strict=True)]
        return self.held


POWERS = Powers(BASES)
INVERSES = Powers([pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)])


class Prefixes(NamedTuple):
    """Running sums of a text, one array for each prime; entry k covers the first k code points."""

    sums: tuple[np.ndarray, ...]

    @property
    def size(self) -> int:
        return len(self.sums[0]) - 1

    def spans(self, start: np.ndarray | int, stop: np.ndarray | int) -> tuple[np.ndarray, ...]:
        """Both numbers of each span, wherever it stands; spans of one length are equal if they are."""
        inverses = INVERSES.upto(self.size)
        return tuple((s[stop] - s[start]) % p * h[start] % p for s, h, p in zip(self.sums, inverses, PRIMES, strict=True))

    def joined(self, other: Prefixes, mine: int, theirs: int) -> Prefixes:
        """Of my first ``mine`` code points followed by the first ``theirs`` of other."""
        powers = POWERS.upto(mine)
        return Prefixes(
            tuple(np.concatenate([s[: mine + 1], (s[mine] + o[1 : theirs + 1] * h[mine]) % p]) for s, o, h, p in zip(self.sums, other.sums, powers, PRIMES, strict=True))
        )

    def whole(self) -> int:
        return int(self.sums[0][-1]) << 31 | int(self.sums[1][-1])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def prefixes(text: str) -> Prefixes:
    # no letter is zero, so that leading ones count
    codes = code_points(text) + 1
    powers = POWERS.upto(len(codes))
    return Prefixes(tuple(np.r_[0, np.cumsum(codes * h[: len(codes)] % p) % p] for h, p in zip(powers, PRIMES, strict=True)))


def equal_spans(x: Prefixes, i: int, y: Prefixes, j: int, n: int) -> bool:
    return x.spans(i, i + n) == y.spans(j, j + n)


def common_extension(x: Prefixes, i: int, y: Prefixes, j: int) -> int:
    """How many code points from place i of one text equal those from place j of the other."""
    lo, most = 0, min(x.size - i, y.size - j)
    hi = min(1, most)
    while lo < hi and equal_spans(x, i, y, j, hi):  # at twice the length each time, then by halves
        lo, hi = hi, min(2 * hi, most)
    while lo < hi:
        middle = (lo + hi + 1) // 2
        lo, hi = (middle, hi) if equal_spans(x, i, y, j, middle) else (lo, middle - 1)
    return lo


def sketch(text: Prefixes) -> np.ndarray:
    """The least hash of the text's spans in each range, as BITS bits above zero; zero where a range has none."""
    n, out = text.size, np.zeros(BINS, np.int64)
    if not n:
        return out
    width = WIDTH if n >= 4 * WIDTH else min(SHORT, n)
    start = np.arange(n - width + 1)
    a, b = text.spans(start, start + width)
    mixed = (a.astype(np.uint64) << np.uint64(31) | b.astype(np.uint64)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed = np.sort(mixed * np.uint64(0xBF58476D1CE4E5B9))
    shift = np.uint64(64 - BINS.bit_length() + 1)
    edges = np.searchsorted(mixed, np.arange(BINS, dtype=np.uint64) << shift)
    filled = np.flatnonzero(edges < np.r_[edges[1:], len(mixed)])
    least = mixed[edges[filled]] & ((np.uint64(1) << shift) - np.uint64(1))
    least ^= least >> np.uint64(23)
    out[filled] = 1 + (least * _MIX >> np.uint64(64 - BITS)).astype(np.int64) % ((1 << BITS) - 1)
    return out


def likeness(whole_x: int, x: np.ndarray, whole_y: int, y: np.ndarray) -> float:
    if whole_x == whole_y:
        return 1.0
    both = np.count_nonzero((x > 0) | (y > 0))
    share = np.count_nonzero((x == y) & (x > 0)) / both if both else 0.0
    return 2 * share / (1 + share)


def written(size: int, whole: int, least: np.ndarray) -> str:
    return f"{size:08x}{whole:016x}" + least.astype(">u2").tobytes().hex()


def _part(order: Column, bounds: list) -> Column:
    """In which of the ranges between bounds, which descend, an id falls; null in the last."""

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(order < F.lit(bounds[middle]), among(middle + 1, hi)).otherwise(among(lo, middle))

    return F.when(order.isNull(), len(bounds)).otherwise(among(0, len(bounds)))


def with_next(docs: DataFrame, key: str, text: str, prepare: Callable, made: Callable, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """docs' other columns and made(prepare(text), prepare(the next row's text)), rows by key, a number, descending; after the last comes the first.

    Texts are moved once: rows are dealt out by ranges of key, and the first row of a range goes to the range before too.  What tells the ranges apart
    has one row for each of them.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = [c for c in without(docs, *(n for n, _ in fields)) if c != text]
    share = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx(key, share, 20 * parts).alias("b")).first()["b"] if share else None
    bounds = sorted(set(found or []), reverse=True)
    value, part, first, turn = (unused(docs, n) for n in ("value", "part", "first", "turn"))
    clean = F.coalesce(text, F.lit(""))
    row = docs.select(*kept, clean.alias(value), _part(F.col(key), bounds).alias(part), F.xxhash64(clean).alias(turn))
    tops = row.groupBy(part).agg(F.max(F.struct(F.col(key).alias("k"), F.col(turn).alias("h"))).alias("m"))
    tops = sorted((r[part], r["m"]["k"], r["m"]["h"]) for r in tops.collect())  # one row a range
    before = {p: (tops[n - 1][0], k, h) for n, (p, k, h) in enumerate(tops)}
    listed = [before.get(p, (None, None, None)) for p in range(len(bounds) + 1)]
    of_part = lambda n, kind: F.get(F.array(*(F.lit(x[n]).cast(kind) for x in listed)), F.col(part))
    is_first = F.col(key).eqNullSafe(of_part(1, docs.schema[key].dataType)) & (F.col(turn) == of_part(2, "long"))
    dealt = row.withColumn(first, F.explode(F.when(is_first, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    dealt = dealt.withColumn(part, F.when(F.col(first), of_part(0, "int")).otherwise(F.col(part)))
    # rows of one key come by their text's hash
    dealt = dealt.repartition(parts, part).sortWithinPartitions(F.col(part), F.col(first), F.col(key).desc_nulls_last(), F.col(turn).desc())
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t in fields)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last row, what is prepared of it, and its range; the next one is still to come
        for batch in (small for whole in batches for small in chunks(whole, len(kept), PART_BYTES)):
            texts, ranges, firsts = (batch.column(len(kept) + n).to_pylist() for n in range(3))
            rows, out = [], []
            for k, (t, p, f) in enumerate(zip(texts, ranges, firsts, strict=True)):
                joins = waiting is not None and waiting[2] == p
                if f and not joins:
                    continue
                ready = prepare(t)
                if joins:
                    rows.append(waiting[0])
                    out.append(made(waiting[1], ready))
                waiting = None if f else (batch.slice(k, 1), ready, p)
            if rows:
                whole = pa.Table.from_batches(rows)
                columns = [whole.column(k).combine_chunks() for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([o[k] for o in out]) for k in range(len(fields)))], schema.names)

    return dealt.select(*kept, value, part, first).mapInArrow(read, schema)


class Ready(NamedTuple):
    text: str
    sums: Prefixes
    least: np.ndarray


def ready(text: str) -> Ready:
    sums = prefixes(text)
    return Ready(text, sums, sketch(sums))


def edited_pair(own: Ready, other: Ready) -> tuple:
    """The columns of ``RESULT`` for a text and the next one."""
    third = len(own.text) // 3
    stay, taken = len(own.text) - third, min(third, len(other.text))
    edited = own.text[:stay] + other.text[:taken]
    changed = own.sums.joined(other.sums, stay, taken)
    new = sketch(changed)
    return (
        len(own.text),
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        written(own.sums.size, own.sums.whole(), own.least),
        written(changed.size, changed.whole(), new),
        likeness(own.sums.whole(), own.least, changed.whole(), new),
        likeness(own.sums.whole(), own.least, other.sums.whole(), other.least),
        common_extension(own.sums, 0, other.sums, 0),
    )


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' other columns and ``RESULT``: the text edited by the next one's start, both fingerprints, how alike they and the next text's are, and
    how many code points the text and the next one begin with in common."""
    kinds = (T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType())
    return with_next(docs, key, text, ready, edited_pair, list(zip(RESULT, kinds, strict=True)))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprint_edits(docs).select("doc_id", *RESULT)
