"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

A block of candidates holds, for each component, its rows in order of that component.  A query reads the
lists in step from the end that raises its score, all queries of a block together, and has for every candidate the sum of what it has seen:
with the frontiers of the unread rest that is an upper bound, with the lists' far ends a lower bound.  A
candidate whose upper bound falls below the k-th lower bound cannot qualify; reading stops when few are left, whose scores are then
resolved, and their k-th best is the least bound for the blocks that follow in the task.  Candidates that tie with the k-th bound stay until then, so ties go to the smaller id.

Defined results: see ``vectors`` for what takes part; a query with fewer candidates than k gets all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.vectors import best_of_pairs, once, packed, unpacked, usable

#: Depths, as shares of a list, at which the bounds are drawn, and candidates at which reading stops.
DEPTHS, FEW = (0.5, 0.65, 0.8, 1.0), 64


def sorted_lists(values: np.ndarray) -> bytes:
    """For each component the rows in ascending order of it."""
    return np.argsort(values, axis=0, kind="stable").astype(np.int32).T.tobytes()


def no_random_access(queries: np.ndarray, values: np.ndarray, place: np.ndarray, ends: np.ndarray, k: int, floors: np.ndarray) -> np.ndarray:
    """For each query, the rows of values that may be among the k of highest inner product, ties included, and not below its floor.

    A query without a dimension of its own gets their numbers, queries a mask of queries by rows.
    place: each row's place in each component's ascending list; ends: the lists' values.  A row has been seen in a
    list read to some depth if its place is within that depth, so nothing else of a row is looked at: an unseen value is
    the frontier's to the upper bound and the far end's to the lower one, whatever the query, so that the bounds of all queries are products.
    """
    if queries.ndim == 1:
        return np.flatnonzero(no_random_access(queries[None], values, place, ends, k, np.array([floors]))[0])
    n = len(values)
    keep = np.ones((len(queries), n), bool)
    if n <= max(FEW, k):
        return keep
    falling, rising = np.maximum(queries, 0), np.minimum(queries, 0)  # lists read from their high end, and from their low end
    left = np.arange(len(queries))
    for depth in DEPTHS:
        read = min(n, max(k, int(n * depth)))
        down, up = falling[left], rising[left]
        upper = down @ np.maximum(values, ends[n - read]).T + up @ np.minimum(values, ends[read - 1]).T
        lower = down @ np.where(place >= n - read, values, ends[0]).T + up @ np.where(place < read, values, ends[-1]).T
        kth = np.maximum(floors[left], np.partition(lower, n - k, axis=1)[:, n - k])
        keep[left] &= upper >= kth[:, None]
        left = left[keep[left].sum(1) > max(FEW, k)]
        if not len(left):
            break
    return keep


def top_products(rows: DataFrame, is_query: Column, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row the k other rows of highest integer inner product."""
    each = once(rows.withColumn("_q", is_query).where(usable(F.col(vector))), key, vector)
    whole = each.withColumn("vector", F.transform("vector", lambda x: F.floor(x)))
    candidates = packed(whole, np.int64, sorted_lists, copies=k + 1)
    chosen = once(rows.where(is_query).select(key).withColumn("_v", F.array(F.lit(0))), key, "_v").select("id")
    queries = packed(whole.join(chosen, "id", "left_semi"), np.int64, size=512)

    def search(q: pd.Series, blocks: list[pd.Series]) -> pd.DataFrame:
        qids, every = unpacked(q, np.int64)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qids]  # ids and scores, best first
        for c in blocks:
            cids, values = unpacked(c, np.int64)
            width = min(every.shape[1], values.shape[1])  # what lies beyond is multiplied by padding
            asked, values = every[:, :width], values[:, :width]
            lists = np.frombuffer(c["extra"], np.int32).reshape(-1, len(cids))[:width].T
            place = np.empty(lists.shape, np.int16 if len(cids) < 1 << 15 else np.int32)
            np.put_along_axis(place, lists, np.arange(len(cids), dtype=place.dtype)[:, None], 0)
            ends = np.take_along_axis(values, lists, 0)
            # floats hold the sums exactly up to 2**24 or 2**53, and are faster
            largest = float(np.abs(asked).max(initial=0)) * float(np.abs(values).max(initial=0)) * max(width, 1)
            kind = np.float32 if largest < 2.0**24 else np.float64 if largest < 2.0**53 else np.int64
            least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
            floors = np.array([scores[k - 1] if len(scores) == k else least for _, scores in best], np.int64 if kind is np.int64 else np.float64)
            # one more, as the query's own row may be among them
            keep = no_random_access(asked.astype(kind), values.astype(kind), place, ends.astype(kind), k + 1, floors)
            for n, (qid, query) in enumerate(zip(qids, asked, strict=True)):
                ids, scores = best[n]
                rows = np.flatnonzero(keep[n])
                rows = rows[cids[rows] != qid]
                ids, scores = np.r_[ids, cids[rows]], np.r_[scores, values[rows] @ query]
                order = np.lexsort((ids, -scores))[:k]
                best[n] = ids[order], scores[order]
        found = [pd.DataFrame({"query_id": qid, "vec_id": ids, "score": scores}) for qid, (ids, scores) in zip(qids, best, strict=True)]
        return pd.concat(found)

    return best_of_pairs(queries, candidates, search, "long", k, largest=True)


def op2(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.transform("embedding", lambda x: 256 * x.cast("double")).alias("scaled")
    )
    return top_products(rows, F.col("vec_id") % 50 == 0, "vec_id", "scaled", 5)


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
),
parts as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as d from v),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
  from parts q join parts c on q.d = c.d and q.vec_id % 50 = 0 and q.vec_id != c.vec_id group by all
),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
