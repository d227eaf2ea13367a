"""Periodic runs of words, by internal pattern matching.

A run is a stretch of words whose smallest period is ``q``, at least ``max(LEAST, TIMES q)`` long, that no neighbouring word extends.  A text is cut into
dyadic blocks: for each length ``b`` the blocks that start at its multiples.  A run of period ``q`` holds a block of the largest length that is not
above ``q`` (eight words at least), and ``q`` words on the block occurs again, so each block's occurrences in the neighbouring window are
queried: those of its class are an interval of the suffix array, and a wavelet tree over the suffix array gives the least of
the interval that is not before a place (range successor).  In a window of the block's length occurrences are an arithmetic progression.  One or two
are candidate periods as they are; of a longer progression with difference ``d`` at most two are, those that bring the edges of the stretches of period ``d`` around
the block and around the progression together (all others would give the run a smaller period).  Candidates are extended to both sides by
longest common extensions over the classes of dyadic lengths, and kept if they are long enough, the least period of each stretch.

The suffix array is refined by doubling: words, then pairs, and so on; what is told apart already is not sorted again, and of the texts of a batch, which share
the arrays, those in which no block of eight words occurs twice are left aside from there on.

Defined results: null and wordless texts have no runs and keep no words; repeated rows give repeated results; other columns are kept, but for
those of the results' names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import unused, without
from concordat.llm.subwords import chunks

#: The least length of a run, in words and in periods.
LEAST, TIMES = 24, 3
#: Words of the shortest block, as a power of two: LEAST words hold two such blocks and a period that is shorter than one.
FIRST = 3
#: Text, in bytes, that a task takes at a time.
PART_BYTES = 1 << 21
RESULT = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


class Classes:
    """Ranks of all stretches of 1, 2, 4 ... places in a row of codes; equal ranks are equal stretches, and a rank is the start of its class in the suffix array."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        order = np.argsort(codes, kind="stable")
        self.rank = [np.zeros(self.n, np.int64)]
        self._name(self.rank[0], order, np.r_[True, np.diff(codes[order]) != 0][: self.n], np.zeros(self.n, np.int64))
        self.active = self._repeated(np.arange(self.n))

    def _name(self, rank: np.ndarray, order: np.ndarray, first: np.ndarray, base: np.ndarray) -> None:
        """Gives sorted places their ranks: base, the start of their class before, and what lies between."""
        if not len(order):
            return
        at = np.arange(len(order))
        head = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
        since = at[first][np.cumsum(first) - 1] - np.repeat(head, np.diff(np.r_[head, len(order)]))
        rank[order] = base + since

    def _repeated(self, places: np.ndarray) -> np.ndarray:
        """Those of places that share their class."""
        return places[np.bincount(self.rank[-1], minlength=self.n)[self.rank[-1][places]] > 1]

    def double(self) -> None:
        """Adds the classes of twice the length.  A repeated stretch ends before its text does, so that its other half is there."""
        rank, half = self.rank[-1], 1 << (len(self.rank) - 1)
        left, right = rank[self.active], rank[np.minimum(self.active + half, self.n - 1)]
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = rank.copy()
        self._name(new, self.active[order], np.r_[True, (np.diff(left) != 0) | (np.diff(right) != 0)][: len(order)], left)
        self.rank.append(new)
        self.active = self._repeated(self.active)

    def kept(self, keep: np.ndarray) -> Classes:
        """The classes of the places kept: whole texts, of which none shares a class with a text that is left aside."""
        out = object.__new__(Classes)
        place = np.cumsum(keep) - 1
        out.n, out.rank = int(keep.sum()), []
        for rank in self.rank:
            held = rank[keep]
            used = np.bincount(held, minlength=self.n)
            out.rank.append((np.cumsum(used) - used)[held])
        out.active = place[self.active[keep[self.active]]]
        return out

    def suffix_array(self) -> np.ndarray:
        out = np.empty(self.n, np.int64)
        out[self.rank[-1]] = np.arange(self.n)
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many places from i and from j on are equal."""
        i, j, size = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.rank))):
            same = self.rank[k][np.minimum(i, self.n - 1)] == self.rank[k][np.minimum(j, self.n - 1)]
            same &= (i < self.n) & (j < self.n)
            step = same.astype(np.int64) << k
            i, j, size = i + step, j + step, size + step
        return size

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many places before i and before j are equal; i < j."""
        i, j, size = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.rank))):
            a, b = i - (1 << k), j - (1 << k)
            same = (self.rank[k][np.maximum(a, 0)] == self.rank[k][np.maximum(b, 0)]) & (a >= 0)
            step = same.astype(np.int64) << k
            i, j, size = i - step, j - step, size + step
        return size


class Wavelets:
    """A wavelet tree over an array of numbers below 2^bits: for each bit, from the highest on, how many ones stand before each place."""

    def __init__(self, values: np.ndarray):
        self.bits, self.ones, self.zeros = max(1, int(values.max(initial=0)).bit_length()), [], []
        for bit in reversed(range(self.bits)):
            one = values >> bit & 1
            self.ones.append(np.r_[0, np.cumsum(one)])
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers of each interval are less than value."""
        found, every = np.zeros(len(lo), np.int64), hi - lo
        for k, bit in enumerate(reversed(range(self.bits))):
            a, b = self.ones[k][lo], self.ones[k][hi]
            one = (value >> bit & 1).astype(bool)
            found += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return np.where(value >> self.bits > 0, every, found)

    def ranked(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number at each place of the interval's sorted order."""
        found = np.zeros(len(lo), np.int64)
        for k, bit in enumerate(reversed(range(self.bits))):
            a, b = self.ones[k][lo], self.ones[k][hi]
            zeros = (hi - b) - (lo - a)
            one = place >= zeros
            found |= one.astype(np.int64) << bit
            place = np.where(one, place - zeros, place)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return found


def candidates(classes: Classes, wavelets: Wavelets, blocks: np.ndarray, level: int, offsets: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(block start, period): candidates from the blocks' occurrences at offsets[0] <= offset < offsets[1], no more than a block's length apart."""
    rank = classes.rank[level]
    lo = rank[blocks]
    hi = lo + np.bincount(rank, minlength=classes.n)[lo]
    before, upto = (wavelets.below(lo, hi, blocks + o) for o in offsets)
    count = upto - before

    def occurrence(rows: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The range successors of the window's start: its number-th, from 0."""
        return wavelets.ranked(lo[rows], hi[rows], before[rows] + number)

    found = []
    for number in (0, 1):
        rows = np.flatnonzero((count > number) & (count <= 2))
        found.append((blocks[rows], occurrence(rows, np.full(len(rows), number)) - blocks[rows]))
    rows = np.flatnonzero(count > 2)
    if len(rows):
        i = blocks[rows]
        first, second = occurrence(rows, np.zeros(len(rows), np.int64)), occurrence(rows, np.ones(len(rows), np.int64))
        apart = second - first
        edges = lambda x: (x - classes.behind(x, x + apart), x + apart + classes.ahead(x, x + apart))
        (start, stop), (other_start, other_stop) = edges(i), edges(first)
        for period in (other_stop - stop, other_start - start):
            fits = (start != other_start) & (period >= offsets[0]) & (period < offsets[1])
            found.append((i[fits], period[fits]))
        if offsets[0] == 1:  # the block overlaps the window: its own least period is the progression's difference
            found.append((i, apart))
            found.append((i, first - i))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period), sorted, of all runs of texts whose words' numbers stand in a row, edges[k] to edges[k + 1] those of text k."""
    none = (np.zeros(0, np.int64),) * 4
    sizes = np.diff(edges)
    texts = np.flatnonzero(sizes >= LEAST)
    if not len(texts):
        return none
    # a last place of its own for every text, so that nothing runs over its end
    sizes = sizes[texts] + 1
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) - starts[owner]
    last = at == sizes[owner] - 1
    word = np.where(last, -1, words[np.minimum(edges[texts][owner] + at, len(words) - 1)]) + 1
    classes = Classes(owner * (int(words.max(initial=0)) + 2) + word)
    while len(classes.rank) <= FIRST and len(classes.active):
        classes.double()
    alike = classes.active[at[classes.active] % (1 << FIRST) == 0]
    if not len(alike):
        return none
    hit = np.zeros(len(texts), bool)
    hit[owner[alike]] = True
    keep = hit[owner]
    classes, owner, at = classes.kept(keep), owner[keep], at[keep]
    while len(classes.active):
        classes.double()
    wavelets = Wavelets(classes.suffix_array())
    found = []
    for level in range(FIRST, len(classes.rank)):
        size = 1 << level
        counts = np.bincount(classes.rank[level], minlength=classes.n)
        blocks = np.flatnonzero((at % size == 0) & (counts[classes.rank[level]] > 1))
        for offsets in ((1, size), (size, 2 * size)) if level == FIRST else ((size, 2 * size),):
            found.append(candidates(classes, wavelets, blocks, level, offsets))
    block, period = (np.concatenate(x) for x in zip(*found, strict=True))
    block, period = np.unique(np.stack([block, period]), axis=1) if len(block) else (block, period)
    start = block - classes.behind(block, block + period)
    length = block + period + classes.ahead(block, block + period) - start
    good = (length >= LEAST) & (length >= TIMES * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch has one least period, which its others are multiples of
    one = np.r_[True, (np.diff(start) != 0) | (np.diff(length) != 0)][: len(start)]
    start, length, period = start[one], length[one], period[one]
    text = texts[owner[start]]
    start = at[start]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def dropped(start: np.ndarray, length: np.ndarray, period: np.ndarray, n: int) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    change = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def summaries(texts: list[list[bytes]]) -> list[tuple]:
    """The columns of ``RESULT`` for each text's words."""
    numbers = _Numbers()
    edges = np.r_[0, np.cumsum(list(map(len, texts)))].astype(np.int64)
    flat = np.fromiter((numbers[w] for words in texts for w in words), np.int64, int(edges[-1]))
    owner, start, length, period = find_runs(flat, edges)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, words in enumerate(texts):
        own = slice(bounds[k], bounds[k + 1])
        runs = list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist(), strict=True))
        best, kept = (None,) * 4, words
        if runs:
            s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
            best = (s, n, q, 1000 * n // q)
            gone = dropped(start[own], length[own], period[own], len(words))
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out.append((len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def periodic_runs(docs: DataFrame, text: str = "text", key: str | None = None, words: Callable[[str | None, str | None], list[bytes]] | None = None) -> DataFrame:
    """docs' other columns and ``RESULT``.  words(text, key as text), if given, are a row's words instead of the text's own."""
    names = without(docs, *RESULT)
    kept = [c for c in names if c != text]
    kinds = [T.LongType()] * 5 + [T.StringType()] * 2
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, k) for n, k in zip(RESULT, kinds, strict=True))])
    value, mark = unused(docs, "value"), unused(docs, "mark")
    row = docs.select(*kept, F.col(key).cast("string").alias(mark) if key else F.lit(None).cast("string").alias(mark), F.col(text).alias(value))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, whole.num_columns - 1, PART_BYTES)):
            marks, texts = (batch.column(len(kept) + n).to_pylist() for n in (0, 1))
            rows = summaries([words(t, m) for t, m in zip(texts, marks, strict=True)] if words else list(map(split_words, texts)))
            made = [pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.string()) for k in range(len(RESULT))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], schema.names)

    return row.mapInArrow(read, schema)


def planted(text: str | None, key: str | None) -> list[bytes]:
    """A text's words; for one key in ten a stretch of them is repeated to the end, by a rule on the key's checksum."""
    words = split_words(text)
    h = zlib.crc32((key or "").encode())
    if h % 10 or not words or key is None:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return periodic_runs(docs, key="doc_id", words=planted).select("doc_id", *RESULT)
