"""Reconciliation: one result for every key of two tables, unusable keys apart.

Each side is grouped by its normalised key (one shuffle a side, with partial aggregation), and the groups meet
in a full outer join on that key, which reuses the grouping's partitioning.  Rows without a usable key go the same way, each as a group of its own,
so that a side is read once; the totals of a summary are the sums of the groups' sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.normalize import differs, displayed, normalized
from concordat.sources.jsonfields import column, selected, undiscovered
from concordat.spec import ReconError, ReconSpec

DIFFERENCES = "array<struct<column_a:string,column_b:string,value_a:string,value_b:string>>"
ROWS = "array<array<string>>"
RESULT_COLUMNS = ["result_type", "key", "values_a", "values_b", "duplicate_values_a", "duplicate_values_b", "differences", "_order"]


def prepared(df: DataFrame, keys: Sequence[str], values: Sequence[str], spec: ReconSpec, order: Sequence[str]) -> DataFrame:
    """(rid, key, nkey, vals): row order, shown key, compared key (null parts where unusable), raw values."""
    for name in order:
        if name not in df.columns:
            raise ReconError(f"order column not found: {name}")
    rid = F.struct(*(column(df, c) for c in order)) if order else F.struct(F.monotonically_increasing_id().alias("row"))
    key, value = selected(df, keys, "key column"), selected(df, values, "comparison column")
    rules = spec.normalization
    return df.select(
        rid.alias("rid"),
        F.transform(F.array(*key), lambda c: displayed(c, rules)).alias("key"),
        F.transform(F.array(*key), lambda c: normalized(c, rules)).alias("nkey"),
        F.array(*value).cast("array<string>").alias("vals"),
    )


def usable(nkey: str = "nkey") -> Column:
    return F.forall(nkey, lambda x: x.isNotNull())


def groups(side: DataFrame, name: str, unkeyed: bool = False) -> DataFrame:
    """One row for each usable key: its first row, number of rows and, where several, all rows in source order.

    unkeyed: rows without a usable key stay too, each alone, told by ``apart``, which is empty for the others.
    """
    every = F.transform(F.sort_array(F.collect_list(F.struct("rid", "vals"))), lambda r: r["vals"])
    first = F.min(F.struct("rid", "key", "vals"))
    keys = ["nkey"]
    if unkeyed:
        alone = F.concat(F.lit(name), F.monotonically_increasing_id().cast("string"))
        side, keys = side.withColumn("apart", F.when(usable(), "").otherwise(alone)), ["nkey", "apart"]
    else:
        side = side.where(usable())
    return side.groupBy(*keys).agg(F.count("*").alias("n"), first.alias("first"), F.when(F.count("*") > 1, every).alias("rows")).select(*keys, *(F.col(c).alias(f"{c}_{name}") for c in ("n", "first", "rows")))


def difference_list(met: DataFrame, spec: ReconSpec, name: str) -> DataFrame:
    """Adds the compared pairs that differ, in A's column order, as they are shown."""
    if not (pairs := spec.resolved_pairs()):
        return met.withColumn(name, F.array().cast(DIFFERENCES))
    kept, rules = met.columns, spec.normalization
    pair = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    compared = lambda s: F.when(pair, F.transform(f"first_{s}.vals", lambda v: normalized(v, rules)))
    met = met.withColumns({"_na": compared("a"), "_nb": compared("b")})
    met = met.withColumns({f"_n{s}{k}": F.get(f"_n{s}", p[s == "b"]) for k, p in enumerate(pairs) for s in "ab"})
    apart = {k: differs(F.col(f"_na{k}"), F.col(f"_nb{k}"), spec.json_equality) for k in range(len(pairs))}
    show = lambda s, i: displayed(F.get(f"first_{s}.vals", i), rules)
    found = [
        F.when(
            apart[k],
            F.struct(
                F.lit(spec.values_a[i]).alias("column_a"), F.lit(spec.values_b[j]).alias("column_b"), show("a", i).alias("value_a"), show("b", j).alias("value_b")
            ),
        )
        for k, (i, j) in enumerate(pairs)
    ]
    listed = F.when(pair, F.array_compact(F.array(*found))).otherwise(F.array()).cast(DIFFERENCES)
    return met.select(*kept, listed.alias(name))


def shown(values: Column, spec: ReconSpec) -> Column:
    return F.transform(values, lambda v: displayed(v, spec.normalization))


def resolved(met: DataFrame, spec: ReconSpec, order: Column) -> DataFrame:
    """Results of rows (n_a, first_a, rows_a, n_b, first_b, rows_b), one side of which may be null, with the number of rows of each side."""
    none, empty = F.array().cast("array<string>"), F.array().cast(ROWS)
    n_a, n_b = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    single = (n_a <= 1) & (n_b <= 1)
    met = difference_list(met.withColumn("_place", order), spec, "_diffs")
    alone = F.col("apart") != "" if "apart" in met.columns else F.lit(False)
    kind = (
        F.when(alone, F.when(n_b == 0, "unkeyed_right").otherwise("unkeyed_left"))
        .when((n_a > 1) & (n_b > 1), "duplicate_both")
        .when(n_a > 1, "duplicate_file_a")
        .when(n_b > 1, "duplicate_file_b")
        .when(n_a == 0, "missing_left")
        .when(n_b == 0, "missing_right")
        .when(F.size("_diffs") > 0, "mismatch")
        .otherwise("match")
    )
    side = lambda s, n: F.when(single & (n == 1), shown(F.col(f"first_{s}.vals"), spec)).otherwise(none)
    rows = lambda s, n: F.when(n > 1, F.transform(f"rows_{s}", lambda r: shown(r, spec))).otherwise(empty)
    return met.select(
        kind.alias("result_type"),
        F.coalesce("first_a.key", "first_b.key").alias("key"),
        side("a", n_a).alias("values_a"),
        side("b", n_b).alias("values_b"),
        rows("a", n_a).alias("duplicate_values_a"),
        rows("b", n_b).alias("duplicate_values_b"),
        F.col("_diffs").alias("differences"),
        F.col("_place").alias("_order"),
        n_a.alias("n_a"),
        n_b.alias("n_b"),
    )


def ordering(phase: Column, first_a: Column | None, first_b: Column | None, rank: Column | None = None, nkey: Column | None = None) -> Column:
    """A total order of results: phase, preference of flexible pairs, first row of the leading side, key.

    Row orders of the two sides are of different types, so each has a field of its own.
    """
    return F.struct(
        phase.alias("phase"),
        (rank if rank is not None else F.lit(0)).cast("long").alias("rank"),
        first_a.alias("first_a"),
        first_b.alias("first_b"),
        (nkey if nkey is not None else F.lit(None).cast("array<string>")).alias("key"),
    )


def unkeyed(side: DataFrame, spec: ReconSpec, name: str, other: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    blank = F.lit(None).cast(other.schema["rid"].dataType)
    values = shown(F.col("vals"), spec)
    rid = F.col("rid")
    return side.where(~usable()).select(
        F.lit("unkeyed_right" if name == "a" else "unkeyed_left").alias("result_type"),
        "key",
        (values if name == "a" else none).alias("values_a"),
        (values if name == "b" else none).alias("values_b"),
        F.array().cast(ROWS).alias("duplicate_values_a"),
        F.array().cast(ROWS).alias("duplicate_values_b"),
        F.array().cast(DIFFERENCES).alias("differences"),
        (ordering(F.lit(0), rid, blank) if name == "a" else ordering(F.lit(1), blank, rid)).alias("_order"),
        F.lit(int(name == "a")).cast("long").alias("n_a"),
        F.lit(int(name == "b")).cast("long").alias("n_b"),
    )


@dataclass(frozen=True)
class Reconciliation:
    """Lazy results and what they came from; ``counted`` has the results with the number of rows of each side, n_a and n_b."""

    results: DataFrame
    spec: ReconSpec
    side_a: DataFrame
    side_b: DataFrame
    counted: DataFrame

    @cached_property
    def ordered(self) -> DataFrame:
        return self.results.orderBy("_order")

    def summary(self) -> DataFrame:
        """One row of counters."""
        return summarize(self.counted)


def reconcile(df_a: DataFrame, df_b: DataFrame, spec: ReconSpec) -> Reconciliation:
    """Every key's result.  Without order columns ties follow the scan's order."""
    spec.validate()
    a = prepared(df_a, spec.keys_a, spec.values_a, spec, spec.order_a)
    b = prepared(df_b, spec.keys_b, spec.values_b, spec, spec.order_b)
    if spec.check_fields:
        for side, df, chosen in (("File A", df_a, (*spec.keys_a, *spec.values_a)), ("File B", df_b, (*spec.keys_b, *spec.values_b))):
            if missing := undiscovered(df, chosen):
                raise ReconError(f"{side}: no cell holds the fields {', '.join(missing)}")
    if spec.flexible:
        from concordat.operators.flexible import matched_groups

        met = matched_groups(groups(a, "a"), groups(b, "b"), spec)
        rank = F.col("rank")
    else:
        met = groups(a, "a", unkeyed=True).join(groups(b, "b", unkeyed=True), ["nkey", "apart"], "full_outer")
        rank = None
    first_a, first_b = F.col("first_a.rid"), F.col("first_b.rid")
    paired = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    if spec.flexible:
        phase = F.when(paired, 2).when(F.col("n_a").isNotNull(), 3).otherwise(4)
        order = ordering(phase, first_a, first_b, F.coalesce(rank, F.lit(0)), F.col("nkey"))
        counted = unkeyed(a, spec, "a", b).unionByName(unkeyed(b, spec, "b", a)).unionByName(resolved(met, spec, order))
    else:
        alone, on_a = F.col("apart") != "", F.col("n_a").isNotNull()
        phase = F.when(alone, F.when(on_a, 0).otherwise(1)).when(on_a, 2).otherwise(3)
        order = ordering(phase, first_a, F.when(F.col("n_a").isNull(), first_b), None, F.when(~alone, F.col("nkey")))
        counted = resolved(met, spec, order)
    return Reconciliation(counted.select(*RESULT_COLUMNS), spec, df_a, df_b, counted)


COUNTED = {
    "matches": ["match"],
    "mismatches": ["mismatch"],
    "missing_left": ["missing_left"],
    "missing_right": ["missing_right"],
    "unkeyed_left": ["unkeyed_left"],
    "unkeyed_right": ["unkeyed_right"],
    "duplicates_a": ["duplicate_file_a", "duplicate_both"],
    "duplicates_b": ["duplicate_file_b", "duplicate_both"],
}


def summarize(counted: DataFrame) -> DataFrame:
    """total_rows_a, total_rows_b and a count for each kind, of results with n_a and n_b; a key that is duplicated on both sides counts on both."""
    totals = (F.coalesce(F.sum(f"n_{s}"), F.lit(0).cast("long")).alias(f"total_rows_{s}") for s in "ab")
    return counted.agg(*totals, *(F.count_if(F.col("result_type").isin(kinds)).alias(name) for name, kinds in COUNTED.items()))
