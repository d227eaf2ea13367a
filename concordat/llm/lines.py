"""Line dedup: repeated runs of lines by distributed prefix doubling.

A document is a sequence of its lines that are not blank.  Positions rank by the run of lines that starts there, and the rank
of a run is the place of its first copy: a run of one line from a count of lines, a run of
``2**(k+1)`` lines from the ranks of its two halves, as in building a suffix array by prefix doubling.  Positions of
equal rank are an interval of the suffix array whose longest common prefix is at least that run; those alone in
their interval leave, so every round handles repeated runs only.

A repeated run counts from ``min_words`` words on.  Whatever such a run is, it is covered by its shortest
parts that reach ``min_words`` forward from a line or backward from one; a part of m lines is told by the ranks of the
two runs of ``2**floor(log2 m)`` lines that cover it, so that the rounds needed depend on ``min_words`` and not on
the corpus.  Of equal parts the first in order of (key, line) stays, and the lines of all later ones that do not overlap it are deleted.

Defined results: lines are compared without blanks at their ends; a blank line goes with the line before
it; null texts stay null and empty ones empty; rows that repeat key and text get the same decision, so neither
is a later copy of the other; every row of the input is a row of the result, with its other columns as they are; a column of the name
``deleted`` is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import unused, without
from concordat.operators.graph import cut

#: Words from which a repeated run counts.
MIN_WORDS = 5


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\x0b"))), lambda x: x != "")


def positions(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(d, t, j, h, g, w): document, its text's hash, line, two hashes of the line, which tell lines apart by 128 bits, its words up to min_words."""
    many = rf"^(?:\S+\s+){{{min_words - 1}}}\S"
    return docs.select(
        F.col(key).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(lines_of(F.col(text))).alias("j", "line")
    ).select(
        "d",
        "t",
        "j",
        F.xxhash64("line").alias("h"),
        F.xxhash64(F.lit(1), "line").alias("g"),
        F.when(F.col("line").rlike(many), min_words).otherwise(F.size(F.split("line", r"\s+"))).alias("w"),
    )


def place() -> Column:
    return F.struct("d", "t", "j")


def ranked(places: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Adds rank, the first place that agrees in keys, to the places; null where there is no second one."""
    groups = cut(
        places.where(" and ".join(f"{k} is not null" for k in keys))
        .groupBy(*keys)
        .agg(F.min(place()).alias(rank), F.max(place()).alias("_last"))
        .where(f"{rank} != _last")
        .drop("_last")
    )
    return places.join(groups, keys, "left")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, j, w, r0, r1, ...): the lines that occur elsewhere, and the ranks of the runs of 1, 2, 4 ... lines from each."""
    places = ranked(positions(docs, key, text, min_words), ["h", "g"], "r0").where("r0 is not null").drop("h", "g")
    places = cut(places.dropDuplicates(["d", "t", "j"]))  # rows that repeat key and text have each place once
    k = 0
    while 2 << k <= min_words:
        ahead = W.partitionBy("d", "t").orderBy("j").rangeBetween(1 << k, 1 << k)
        halves = places.withColumn("_next", F.max(f"r{k}").over(ahead))
        places = cut(ranked(halves, [f"r{k}", "_next"], f"r{k + 1}").drop("_next"))
        k += 1
    return places


def later_copies(places: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, lines): the lines to delete from each document."""
    levels = sum(c.startswith("r") and c[1:].isdigit() for c in places.columns)
    window = W.partitionBy("d", "t").orderBy("j")
    item = F.struct("j", "w", *(f"r{k}" for k in range(levels)))
    here = F.col("j")

    def shortest(run: Column, sign: int) -> Column:
        """How many of the lines on from here, without a gap, reach min_words; null if none do."""
        state = F.struct(F.lit(0).alias("m"), F.lit(0).alias("words"))
        ends = F.aggregate(
            run,
            state,
            lambda s, x: F.when(
                (s["words"] < min_words) & (x["j"] == here + sign * s["m"]),
                F.struct((s["m"] + 1).alias("m"), (s["words"] + x["w"]).alias("words")),
            ).otherwise(s),
        )
        return F.when(ends["words"] >= min_words, ends["m"])

    seen = (
        places.select("d", "t", "j", F.collect_list(item).over(window.rangeBetween(0, min_words - 1)).alias("on"),
                      F.reverse(F.collect_list(item).over(window.rangeBetween(1 - min_words, 0))).alias("back"))
        .withColumn("m", shortest(F.col("on"), 1))
        .withColumn("mb", shortest(F.col("back"), -1))
    )

    def part(m: Column, run: Column, start: Column, first: int | None) -> Column:
        """struct(j, m, a, b): a part of m lines from start by the two ranks that cover it."""

        def at(lines: Column, rank: str) -> Column:
            return F.get(run, lines)[rank]

        ranks = F.lit(None)
        for k in range(levels):
            size = 1 << k
            a, b = (F.lit(0), m - size) if first == 0 else (m - 1, F.lit(size - 1))
            pair = F.struct(at(a, f"r{k}").alias("a"), at(b, f"r{k}").alias("b"))
            ranks = pair if k == 0 else F.when(m >= size, pair).otherwise(ranks)
        return F.struct(start.alias("j"), m.alias("m"), ranks["a"].alias("a"), ranks["b"].alias("b"))

    parts = F.array(part(F.col("m"), F.col("on"), here, 0), part(F.col("mb"), F.col("back"), here - F.col("mb") + 1, None))
    runs = (
        seen.select("d", "t", F.explode(F.filter(parts, lambda p: p["m"].isNotNull() & p["a"].isNotNull() & p["b"].isNotNull())).alias("p"))
        .select("d", "t", "p.*")
        .distinct()
    )
    whole = F.col("m").isin([1 << k for k in range(levels)])  # such a part's rank is its first place already
    known = runs.where(whole).withColumn("first", F.col("a"))
    told = ranked(cut(runs.where(~whole)), ["m", "a", "b"], "first")
    overlaps = F.col("first.d").eqNullSafe(F.col("d")) & (F.col("first.t") == F.col("t")) & (F.col("j") < F.col("first.j") + F.col("m"))
    gone = known.union(told.select(known.columns)).where("first is not null").where((F.col("first") < place()) & ~overlaps)
    return (
        gone.select("d", "t", F.explode(F.sequence(F.col("j"), F.col("j") + F.col("m") - 1)).alias("line"))
        .groupBy("d", "t")
        .agg(F.sort_array(F.collect_set("line")).alias("lines"))
    )


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, deleted: str | None = None
) -> DataFrame:
    """docs with the lines of later copies deleted from text; deleted: a column for the numbers of those lines."""
    gone = later_copies(repeated(docs, key, text, min_words), min_words)
    names = without(docs, deleted) if deleted else docs.columns
    joined = docs.alias("docs").join(
        gone.alias("gone"), F.col(f"docs.{key}").eqNullSafe(F.col("gone.d")) & (F.xxhash64(f"docs.{text}") == F.col("gone.t")), "left"
    )
    # of texts without a line to delete nothing is rewritten
    mark = unused(docs, "lines")
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(mark, T.ArrayType(T.IntegerType()))])
    at = names.index(text)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                value.as_py() if not lines.is_valid else without_lines(value.as_py() or "", set(lines.as_py()))
                for value, lines in zip(batch.column(at), batch.column(len(names)), strict=True)
            ]
            columns = [*batch.columns]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    done = joined.select(*(F.col(f"docs.`{c}`") for c in names), F.col("gone.lines").alias(mark)).mapInArrow(rewritten, schema)
    if not deleted:
        return done.select(*names)
    return done.select(*names, F.coalesce(mark, F.array().cast("array<int>")).alias(deleted))


def without_lines(text: str, gone: set[int]) -> str:
    kept, number, dropped = [], -1, False
    for line in text.split("\n"):
        if line.strip(" \t\r\f\x0b"):
            number += 1
            dropped = number in gone
        if not dropped:
            kept.append(line)
    return "\n".join(kept)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, deleted="deleted_lines")
