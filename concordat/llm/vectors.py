"""Blocks of vectors, and the meeting of query blocks with candidate blocks.

Rows are dealt into blocks of bounded size by the hash of their id; a block is packed once (with
whatever index it needs) and a query block meets a run of candidate blocks in one task.  The
best of each task are few rows, and a window over each query's rows ends the search.

A vector takes part if it is not null and holds no null or non-finite component.  Vectors of unequal
length are padded with zeros.  Rows that repeat an id count once, by the least vector.  Of candidates with equal vectors a block keeps
as many as a result can list, those of the smallest ids, since no others can be in it.  Rows without an id take no part.  Results hold
their own columns only, so that the names of the others do not matter; an empty table, or one without a query or a usable vector, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.operators.graph import cut


#: Vectors in a block, and candidate blocks that one task takes for a query block.
BLOCK, RUN = 4096, 8
PACKED = "block long, ids binary, width int, values binary, extra binary"


def usable(vector: Column) -> Column:
    value = F.transform(vector, lambda x: x.cast("double"))
    return vector.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def once(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector), one row for each id."""
    return rows.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(vector).alias("vector")).where("id is not null")


def packed(rows: DataFrame, kind: type, index: Callable[[np.ndarray], bytes] | None = None, size: int = BLOCK, copies: int | None = None) -> DataFrame:
    """PACKED rows of (id, vector) rows; kind: int64 or float64; index: what else is stored of a block's matrix; copies: rows of equal vectors that a block keeps."""
    blocks = max(1, math.ceil(rows.count() / size))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        width = int(part["vector"].map(len).max())
        values = np.zeros((len(part), width), kind)
        for k, v in enumerate(part["vector"]):
            values[k, : len(v)] = v
        ids = part["id"].to_numpy(np.int64)
        if copies is not None:
            same = pd.Series([v.tobytes() for v in values])
            keep = (same.groupby(same).cumcount() < copies).to_numpy()
            ids, values = ids[keep], values[keep]
        return pd.DataFrame(
            {
                "block": [int(part["block"].iloc[0])],
                "ids": [ids.tobytes()],
                "width": [width],
                "values": [values.tobytes()],
                "extra": [index(values) if index else b""],
            }
        )

    return cut(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInPandas(pack, PACKED))


def unpacked(row, kind: type) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["values"], kind).reshape(len(ids), row["width"])


def best_of_pairs(
    queries: DataFrame, candidates: DataFrame, search: Callable[[pd.Series, list[pd.Series]], pd.DataFrame], score: str, most: int, largest: bool
) -> DataFrame:
    """(query_id, rank, vec_id, score) from search(query block, candidate blocks), which returns (query_id, vec_id, score) rows."""
    sizes = {name: df.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1 for name, df in (("q", queries), ("c", candidates))}
    schema = f"query_id long, vec_id long, score {score}"

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        columns = [F.col(c).alias(f"{own}_{c}") for c in df.columns if c != "block"]
        if not sizes[other]:
            return df.limit(0).select(F.col("block").alias(own), F.col("block").alias(other), *columns)
        return df.select(F.col("block").alias(own), F.explode(F.sequence(F.lit(0), F.lit(sizes[other] - 1))).alias(other), *columns)

    def met(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("c")
        part = {own: pair.filter(regex=f"^{own}_").rename(columns=lambda c: c[2:]) for own in "qc"}
        return search(part["q"].iloc[0], [row for _, row in part["c"].iterrows()])

    pairs = side(queries, "q", "c").join(side(candidates, "c", "q"), ["q", "c"])
    found = pairs.groupBy("q", F.floor(F.col("c") / RUN).alias("run")).applyInPandas(met, schema)
    order = [F.desc("score") if largest else F.asc("score"), F.asc("vec_id")]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
