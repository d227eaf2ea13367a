"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one of each of ``BOOKS`` residual codebooks, found by beam
search; the squared norm of that sum is stored with the codes.  A query's distance to a coded
vector is then the norm less twice a sum of ``BOOKS`` entries of its look-up table of inner products.  The coding error of each
vector is stored too: added to that measure it estimates the squared distance to the vector itself, and, spread over all directions, says how far the
estimate may be off.  The best ``RERANK`` of every block are measured exactly on the original vectors, and then
all whose estimate less ``SIGMAS`` deviations is under the k-th of those; so wide or unstructured vectors, which code badly, are reranked in greater number.

The codebooks are learned by k-means on residuals of a bounded sample; every row is coded.  Of exact copies, which tie in
both measures, the smaller ids come first.

Defined results: see ``vectors`` for what takes part; zero vectors do not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.vectors import best_of_pairs, once, packed, unpacked, usable

#: Vectors that the codebooks are learned from.
SAMPLE = 8192
BOOKS, WORDS, BEAM, ROUNDS, RERANK, SIGMAS, SEED = 8, 128, 4, 8, 64, 3.0, 11


def learn(sample: np.ndarray) -> np.ndarray:
    """Codebooks of shape (BOOKS, WORDS, width), each by k-means on what the ones before leave."""
    rng = np.random.default_rng(SEED)
    rest, books = sample.copy(), np.zeros((BOOKS, WORDS, sample.shape[1]))
    for book in books:
        if not len(rest):
            break
        book[:] = rest[rng.choice(len(rest), WORDS, replace=len(rest) < WORDS)]
        for _ in range(ROUNDS):
            near = np.argmin((book**2).sum(1) - 2 * rest @ book.T, 1)
            count = np.bincount(near, minlength=WORDS)
            order = np.argsort(near, kind="stable")
            filled = np.flatnonzero(count)
            book[filled] = np.add.reduceat(rest[order], np.r_[0, np.cumsum(count[filled])[:-1]], 0) / count[filled, None]
        rest = rest - book[np.argmin((book**2).sum(1) - 2 * rest @ book.T, 1)]
    return books


def code(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, squared norms of their sums, squared errors), by beam search over the codebooks in turn."""
    n = len(values)
    codes, rest = np.zeros((n, 1, 0), np.int16), values[:, None, :]
    for book in books:
        error = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
        flat = error.reshape(n, -1)
        best = np.argpartition(flat, min(BEAM, flat.shape[1]) - 1, 1)[:, :BEAM]
        beam, word = best // len(book), best % len(book)
        rest = np.take_along_axis(rest, beam[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), word[:, :, None].astype(np.int16)], 2)
    best = np.argmin((rest**2).sum(2), 1)
    chosen = codes[np.arange(n), best]
    error = rest[np.arange(n), best]
    return chosen, ((values - error) ** 2).sum(1), (error**2).sum(1)


def candidates_of(about: np.ndarray, errors: np.ndarray, width: int, k: int, measure) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their squared distances by measure): the best RERANK by about, and all that may be nearer than the k-th of those.

    about: squared distances to the coded vectors; errors: squared coding errors.
    """
    estimate = about + errors
    first = np.argsort(estimate, kind="stable")[: max(RERANK, k)]
    exact = measure(first)
    if len(first) == len(about):
        return first, exact
    kth = np.partition(exact, k - 1)[k - 1]
    spread = 2 * np.sqrt(np.maximum(about, 0) * errors / max(width, 1))
    may = estimate - SIGMAS * spread <= kth
    may[first] = False
    more = np.flatnonzero(may)
    return np.r_[first, more], np.r_[exact, measure(more)]


def nearest(rows: DataFrame, is_query: Column, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row k near other rows by Euclidean distance."""
    real = rows.where(usable(F.col(vector)) & F.exists(vector, lambda x: x != 0))
    each = once(real, key, vector)
    few = each.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("vector").to_pylist()
    width = max(map(len, few), default=0)
    books = learn(np.array([v + [0.0] * (width - len(v)) for v in few], np.float64).reshape(len(few), width))
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def fitted(values: np.ndarray) -> np.ndarray:
        known = np.zeros((len(values), shared.value.shape[2]))
        known[:, : values.shape[1]] = values[:, : known.shape[1]]
        return known

    def coded(values: np.ndarray) -> bytes:
        known = fitted(values)
        codes, norms, errors = code(known, shared.value)
        errors = errors + np.maximum((values**2).sum(1) - (known**2).sum(1), 0)  # components that the sample does not have
        return codes.tobytes() + norms.tobytes() + errors.tobytes()

    candidates = packed(each, np.float64, coded, copies=k + 1)
    chosen = once(rows.where(is_query).select(key).withColumn("_v", F.array(F.lit(0))), key, "_v").select("id")
    queries = packed(each.join(chosen, "id", "left_semi"), np.float64, size=512)

    def search(q: pd.Series, blocks: list[pd.Series]) -> pd.DataFrame:
        qids, every = unpacked(q, np.float64)
        books = shared.value
        tables = np.einsum("qd,mkd->qmk", fitted(every), books)
        found = []
        for c in blocks:
            cids, values = unpacked(c, np.float64)
            n = len(cids)
            codes = np.frombuffer(c["extra"], np.int16, n * len(books)).reshape(n, len(books))
            norms, errors = np.frombuffer(c["extra"], np.float64, 2 * n, codes.nbytes).reshape(2, n)
            widest = max(every.shape[1], values.shape[1])
            asked = np.pad(every, ((0, 0), (0, widest - every.shape[1])))
            values = np.pad(values, ((0, 0), (0, widest - values.shape[1])))
            for qid, query, table in zip(qids, asked, tables, strict=True):
                about = (query**2).sum() + norms - 2 * sum(table[m][codes[:, m]] for m in range(len(books)))
                # one more, as the query's own row may be among them
                rows, squares = candidates_of(about, errors, widest, k + 1, lambda r: ((values[r] - query) ** 2).sum(1))  # noqa: B023
                other = cids[rows] != qid
                rows, distance = rows[other], np.sqrt(squares[other])
                best = np.lexsort((cids[rows], distance))[:k]
                found.append(pd.DataFrame({"query_id": qid, "vec_id": cids[rows][best], "score": distance[best]}))
        return pd.concat(found)

    return best_of_pairs(queries, candidates, search, "double", k, largest=False)


def op6(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 100 == 0, "vec_id", "embedding", 10)
