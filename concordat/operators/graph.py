"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregation (the least neighbour of each node) and an equi-join back, both of which Spark can
split where a node has very many edges; nothing is collected.  Lineage is cut by checkpoints in the shared folder.
"""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small table that share a partition, and the most nodes that a broadcast tells the least neighbours of.
ROWS, BROADCAST_ROWS = 50_000, 200_000


def set_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names in spark.checkpoint.dir; in local mode a temporary one serves where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        set_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than that many rows need, so that steps over small tables are few tasks."""
    return df.coalesce(max(1, math.ceil(rows / ROWS)))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df as ``cut`` writes it, in few partitions if it is small, and its number of rows."""
    done = cut(df)
    rows = done.count()
    return few(done, rows), rows


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an (a, b) edge; component is the least node reachable.

    Null ends, loops and repeated edges are ignored.  Nodes without an edge are not listed.  The number of rounds grows with the
    logarithm of the number of nodes.
    """
    stars = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (now := tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != before and now[0]:
        before, n = now, now[0]
        told = F.broadcast if 2 * n <= BROADCAST_ROWS else lambda df: df  # an edge has two nodes
        stars = few(stars, n)
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # an edge is met once from its lesser end, so that there are no more than before, repeated ones included
        large = both.join(told(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        stars = cut(few(large.join(told(least), "u").select(F.explode(ends).alias("e")).select("e.*").where("u != v").distinct(), n))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
