"""Saved results laid out for a viewer: pages that read only their own ranges, and a search by three-letter pieces.

Results are written in ranges of their order, parted by bucket and range.  ``_at`` numbers the rows of a range in order, and ``_seat`` the rows
of each bucket within it, both without gaps; ``places`` holds the number of rows of each bucket and range, so that the range and the numbers of any page
are known before a result is read.  A search looks up the rarest piece of its text and confirms the rows that hold that.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.operators.results import BUCKETS, bucket, filter_results, search_results, search_texts
from concordat.spec import ReconError, ReconSpec

#: Range numbers are above these bits of _at and _seat.
RANGE_BITS = 33
#: Letters of a piece, and the rows that a piece may be in to be moved to the results instead of the other way.
PIECE, BROADCAST_ROWS = 3, 500_000


def laid_out(counted: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds bucket, part, _at and _seat; by default the session says how many ranges there are."""
    given = counted.withColumn("bucket", bucket())
    ranged = given.repartitionByRange(ranges, "_order") if ranges else given.repartitionByRange("_order")
    at = ranged.sortWithinPartitions("_order").withColumn("_at", F.monotonically_increasing_id())
    seated = at.sortWithinPartitions("bucket", "_at").withColumn("_seat", F.monotonically_increasing_id())
    return seated.withColumn("part", F.shiftright("_at", RANGE_BITS).cast("int"))


def write_results(counted: DataFrame, folder: str, ranges: int | None = None) -> str:
    """results/ and places/ under folder; returns the schema, by which an empty table can be read."""
    spark, rows = counted.sparkSession, laid_out(counted, ranges)
    rows.write.partitionBy("bucket", "part").parquet(f"{folder}/results")
    written = read_results(spark, folder, rows.schema.json())
    places = written.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.min("_seat").alias("first"))
    places.coalesce(1).write.parquet(f"{folder}/places")
    return rows.schema.json()


def read_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{folder}/results")


def seats(spark: SparkSession, folder: str, size: int, start: int, name: str = "all") -> tuple[int, int] | None:
    """The first and last number of a page, in _at for all results and in _seat for one bucket; None of an empty page."""
    if name not in BUCKETS:
        raise ReconError(f"unknown filter: {name}")
    if size < 0 or start < 0:
        raise ReconError("a page cannot have a negative size or start")
    places = spark.read.parquet(f"{folder}/places")
    first: Column = F.min("first")
    if name == "all":
        first = F.shiftleft(F.first("part").cast("long"), RANGE_BITS)
    else:
        places = places.where(F.col("bucket") == name)
    each = places.groupBy("part").agg(F.sum("n").alias("n"), first.alias("first"))
    # one row for each range
    begun = each.withColumn("begin", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    met = begun.where((F.col("begin") < start + size) & (F.col("begin") + F.col("n") > start))
    lowest = F.min(F.col("first") + F.greatest(start - F.col("begin"), F.lit(0)))
    highest = F.max(F.col("first") + F.least(start + size - F.col("begin"), F.col("n")) - 1)
    low, high = met.agg(lowest, highest).first()
    return None if low is None else (low, high)


def page_of(results: DataFrame, folder: str, size: int = 200, start: int = 0, name: str = "all") -> DataFrame:
    """A page of a saved run's results in their order: what ``page(filter_results(...))`` gives, but only the page's ranges are read."""
    found = seats(results.sparkSession, folder, size, start, name)
    if found is None:
        return filter_results(results, name).where(F.lit(False))
    number = "_at" if name == "all" else "_seat"
    parts = (at >> RANGE_BITS for at in found)
    return filter_results(results, name).where(F.col("part").between(*parts) & F.col(number).between(*found)).orderBy(number)


def pieces(text: Column) -> Column:
    """The distinct pieces of ``PIECE`` letters, at every place of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * PIECE}))"), F.lit(1)))


def write_pieces(results: DataFrame, spec: ReconSpec, folder: str) -> None:
    """pieces/ and piece_counts/ under folder, over all that a row shows; a piece that most rows hold is spread over ranges like any other."""
    spark = results.sparkSession
    held = results.select(F.explode(pieces(search_texts(spec)["all"])).alias("piece"), "_at", "part")
    held.repartitionByRange("piece", "_at").sortWithinPartitions("piece", "_at").write.parquet(f"{folder}/pieces")
    counts = spark.read.parquet(f"{folder}/pieces").groupBy("piece").agg(F.count("*").alias("n"))
    counts.sortWithinPartitions("piece").write.parquet(f"{folder}/piece_counts")


def search_pieces(results: DataFrame, spec: ReconSpec, folder: str, query: str, field: str = "all") -> DataFrame:
    """What ``search_results`` finds, by way of the rarest piece of the query; texts under ``PIECE`` letters are searched row by row."""
    spark, wanted = results.sparkSession, query.strip().lower()
    sought = sorted({wanted[i : i + PIECE] for i in range(len(wanted) - PIECE + 1)})
    if not sought:
        return search_results(results, query, field, spec)
    known = spark.read.parquet(f"{folder}/piece_counts").where(F.col("piece").isin(sought)).collect()  # at most the query's own pieces
    if len(known) < len(sought):
        return results.where(F.lit(False))
    rarest = min(known, key=lambda r: (r["n"], r["piece"]))
    held = spark.read.parquet(f"{folder}/pieces").where(F.col("piece") == rarest["piece"]).select("part", "_at")
    held = F.broadcast(held) if rarest["n"] <= BROADCAST_ROWS else held
    return search_results(results.join(held, ["part", "_at"], "left_semi"), query, field, spec)
