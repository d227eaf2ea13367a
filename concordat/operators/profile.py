"""Column profiles and the overlap of columns' values: two aggregations and one join, whatever the tables' size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.sources.jsonfields import selected

_UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
_FLOAT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def cell_text(value: Column) -> Column:
    """White space collapsed, A to Z in lower case."""
    spaced = F.btrim(F.regexp_replace(value, r"(?U)\s+", " "))
    return F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def value_kind(value: Column) -> Column:
    """uuid, integer, decimal or text."""
    whole = value.rlike("^[+-]?[0-9]+$") & value.try_cast("long").isNotNull()
    return F.when(value.rlike(_UUID), "uuid").when(whole, "integer").when(value.rlike(_FLOAT), "decimal").otherwise("text")


def cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(col, value) of every filled cell; empty cells and the word null are not."""
    pairs = F.array(*(F.struct(F.lit(n).alias("col"), cell_text(c).alias("value")) for n, c in zip(names, selected(df, names), strict=True)))
    return df.select(F.explode(pairs).alias("x")).select("x.*").where("value not in ('', 'null')")


def values_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(col, value, n) of every distinct value."""
    return cells(df, names).groupBy("col", "value").agg(F.count("*").alias("n"))


def profile(values: DataFrame) -> DataFrame:
    """(col, unique_values, non_empty, unique_ratio, kind) of (col, value, n) rows; of equally frequent kinds the more general."""
    kinds = values.groupBy("col", value_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("u"), F.sum("n").alias("n"))
    general = F.coalesce(*(F.when(F.col("kind") == k, r) for k, r in (("text", 3), ("uuid", 2), ("decimal", 1)))  , F.lit(0))
    return kinds.groupBy("col").agg(
        F.sum("u").alias("unique_values"),
        F.sum("n").alias("non_empty"),
        (F.sum("u") / F.sum("n")).alias("unique_ratio"),
        F.max_by("kind", F.struct(F.col("n"), general)).alias("kind"),
    )


def overlap(values_a: DataFrame, values_b: DataFrame) -> DataFrame:
    """(col_a, col_b, shared): distinct values that two columns share; pairs without any are not listed."""
    a, b = (v.select(F.col("col").alias(f"col_{s}"), "value") for s, v in (("a", values_a), ("b", values_b)))
    return a.join(b, "value").groupBy("col_a", "col_b").agg(F.count("*").alias("shared"))


def value_evidence(profile_a: DataFrame, profile_b: DataFrame, shared: DataFrame) -> DataFrame:
    """(col_a, col_b, instance): how strongly values say that two columns are the same."""
    a, b = (p.select([F.col(c).alias(f"{c}_{s}") for c in p.columns]) for s, p in (("a", profile_a), ("b", profile_b)))
    met = shared.join(a, "col_a").join(b, "col_b")
    least, union = F.least("unique_values_a", "unique_values_b"), F.col("unique_values_a") + F.col("unique_values_b") - F.col("shared")
    number = lambda s: F.col(f"kind_{s}").isin("integer", "decimal")
    both = number("a") & number("b")
    ratio = F.least("unique_ratio_a", "unique_ratio_b")
    fits = ((F.col("kind_a") == F.col("kind_b")) | both) & (least >= 3) & F.when(both, ratio >= 0.8).otherwise((least >= 4) & (ratio >= 0.5))
    contained = F.col("shared") / least
    density = F.least("non_empty_a", "non_empty_b") / F.greatest("non_empty_a", "non_empty_b")
    score = F.least(F.lit(0.99), 0.80 * contained + 0.15 * F.col("shared") / union + 0.05 * density)
    return met.where(fits & (F.col("shared") >= 3) & (contained >= 0.85)).select("col_a", "col_b", score.alias("instance"))
