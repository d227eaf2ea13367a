"""Hashed word and byte n-gram features, for whole columns of words at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that a task handles at a time, in bytes; a longer text is handled alone.
CHUNK_BYTES = 8 << 20
#: Words whose features are held at a time.
PART_WORDS = 1 << 14
SIZES = (3, 4, 5)
_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of the column."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    start = 0
    while start < len(sizes):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of each word in order, and the edges of each text's words.  Null texts have none."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    edges = np.asarray(lists.offsets, np.int64)
    words = lists.flatten().dictionary_encode()
    return words.dictionary, np.asarray(words.indices), edges - edges[0]


def parts(words: pa.Array) -> Iterator[tuple[slice, pa.Array]]:
    """The words PART_WORDS at a time, and where they stand: features take some hundred times a word's size."""
    for start in range(0, len(words), PART_WORDS):
        yield slice(start, start + PART_WORDS), words.slice(start, PART_WORDS)


def features(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): the word itself and its byte n-grams, between edge marks, for each word that is not empty.

    buckets is a power of two.
    """
    words = words.cast(pa.large_string())
    sizes = np.asarray(pc.binary_length(words), np.int64) + 2
    raw = np.frombuffer(("<" + "><".join(words.to_pylist()) + ">").encode() if len(words) else b"", np.uint8)
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(raw)) - starts[owner]
    left = sizes[owner] - place
    real = sizes[owner] > 2
    byte = raw.astype(np.uint64)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)

    power = np.ones(int(sizes.max(initial=1)), np.uint64)
    np.multiply.accumulate(np.full(len(power), _P), out=power)
    whole = np.add.reduceat((byte + np.uint64(1)) * power[place], starts) if len(words) else np.zeros(0, np.uint64)
    own = np.flatnonzero(sizes > 2)
    owners, found = [own], [(whole[own] * _MIX) >> shift]
    hashed = byte + np.uint64(1)
    for n in range(2, max(SIZES) + 1):
        hashed = hashed * _P + np.r_[byte[n - 1 :], np.zeros(n - 1, np.uint64)][: len(byte)] + np.uint64(n)
        if n in SIZES:
            fits = np.flatnonzero((left >= n) & real)
            owners.append(owner[fits])
            found.append((hashed[fits] * _MIX) >> shift)
    return np.concatenate([x.astype(np.int32) for x in owners]), np.concatenate([x.astype(np.int32) for x in found])
