"""Views of results: filter, search, sort, counts, overview, and long tables of pairs and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.spec import ReconError, ReconSpec

# Filter buckets, and labels and descriptions of results.
BUCKETS = ("all", "match", "mismatch", "missing_left", "missing_right", "unkeyed_left", "unkeyed_right", "duplicate")
LABELS = {
    "match": "Match", "mismatch": "Mismatch", "missing_left": "Only in File B", "missing_right": "Only in File A",
    "unkeyed_left": "Ignored in File B", "unkeyed_right": "Ignored in File A",
    "duplicate_file_a": "Duplicate", "duplicate_file_b": "Duplicate", "duplicate_both": "Duplicate",
}
DESCRIPTIONS = {
    "missing_left": "Present only in File B for the selected key.",
    "missing_right": "Present only in File A for the selected key.",
    "unkeyed_left": "Skipped because File B has an unusable selected key for this row.",
    "unkeyed_right": "Skipped because File A has an unusable selected key for this row.",
    "duplicate_file_a": "Multiple File A rows share this selected key.",
    "duplicate_file_b": "Multiple File B rows share this selected key.",
    "duplicate_both": "Multiple rows on both sides share this selected key.",
}
FIELDS = ("all", "type", "key", "fileA", "fileB")


def named(texts: dict[str, str], kind: Column | None = None) -> Column:
    kind = F.col("result_type") if kind is None else kind
    return F.coalesce(*(F.when(kind == k, v) for k, v in texts.items()))


def bucket() -> Column:
    return F.when(F.col("result_type").startswith("duplicate"), "duplicate").otherwise(F.col("result_type"))


def filter_results(results: DataFrame, name: str = "all") -> DataFrame:
    if name not in BUCKETS:
        raise ReconError(f"unknown filter: {name}")
    kind = F.col("bucket") if "bucket" in results.columns else bucket()  # saved results are parted by it
    return results if name == "all" else results.where(kind == name)


def facet_counts(results: DataFrame) -> DataFrame:
    """(bucket, n) for every filter, empty ones too."""
    sums = [F.count("*" if b == "all" else F.when(bucket() == b, 1)).alias(b) for b in BUCKETS]
    pairs = F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in BUCKETS))
    return results.agg(*sums).select(F.explode(pairs).alias("x")).select("x.*")


def _flat(rows: str) -> Column:
    return F.array_join(F.flatten(F.col(rows)), " ")


def search_texts(spec: ReconSpec | None) -> dict[str, Column]:
    """What each field of a search looks at; the text of all holds those of the others."""
    join = lambda *parts: F.lower(F.btrim(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")))
    kind = join(named(LABELS), F.col("result_type"), bucket())
    key = join(F.array_join("key", " "))
    sides = [join(F.array_join(f"values_{s}", " "), _flat(f"duplicate_values_{s}")) for s in "ab"]
    each = F.transform("differences", lambda d: F.concat_ws(" ", d["column_a"], d["column_b"], d["value_a"], d["value_b"]))
    details = [named(DESCRIPTIONS), F.array_join(each, " ")]
    if spec is not None:
        details += [F.lit(" ".join(spec.values_a)), F.lit(" ".join(spec.values_b))]
    return {"type": kind, "key": key, "fileA": sides[0], "fileB": sides[1], "all": join(kind, key, *sides, *details)}


def search_results(results: DataFrame, query: str, field: str = "all", spec: ReconSpec | None = None) -> DataFrame:
    """Rows whose text holds the query, any case; an unknown field means all.  spec adds the names of compared columns."""
    wanted = query.strip().lower()
    return results.where(F.contains(search_texts(spec)[field if field in FIELDS else "all"], F.lit(wanted))) if wanted else results


def natural(value: Column) -> Column:
    """A sort key that takes digit runs as numbers; compare it by a collation without case and accents."""
    runs = F.regexp_extract_all(value, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(
        runs,
        lambda r: F.when(
            r.rlike("^[0-9]"), F.concat(F.lpad(F.length(F.ltrim(r, F.lit("0"))).cast("string"), 4, "0"), F.ltrim(r, F.lit("0")))
        ).otherwise(r),
    )
    return F.collate(F.array_join(padded, ""), "UNICODE_CI_AI")


def sort_results(results: DataFrame, by: str | None = None, ascending: bool = True) -> DataFrame:
    """by: type, key, fileA, fileB or details; equal rows, and all without by, stay in result order."""
    texts = {
        "type": named(LABELS),
        "key": F.array_join("key", " "),
        "fileA": F.array_join(F.concat("values_a", F.flatten("duplicate_values_a")), " "),
        "fileB": F.array_join(F.concat("values_b", F.flatten("duplicate_values_b")), " "),
    }
    if by is None:
        return results.orderBy("_order")
    if by != "details" and by not in texts:
        raise ReconError(f"unknown sort column: {by}")
    value = F.size("differences") if by == "details" else natural(texts[by])
    return results.orderBy(value.asc() if ascending else value.desc(), F.col("_order"))


def page(results: DataFrame, size: int = 200, start: int = 0, by: str | None = None, ascending: bool = True) -> DataFrame:
    """The rows that a viewer shows first, or from start."""
    rows = sort_results(results, by, ascending)
    return (rows.offset(start) if start else rows).limit(size)


def paired_values(results: DataFrame, spec: ReconSpec) -> DataFrame:
    """(result_type, key, row_no, column_a, column_b, value_a, value_b), one row for each compared pair of each result row."""
    pairs = spec.resolved_pairs()
    rows = lambda s: F.when(F.size(f"duplicate_values_{s}") > 0, F.col(f"duplicate_values_{s}")).when(F.size(f"values_{s}") > 0, F.array(f"values_{s}"))
    both = F.arrays_zip(F.coalesce(rows("a"), F.array().cast("array<array<string>>")).alias("a"), F.coalesce(rows("b"), F.array().cast("array<array<string>>")).alias("b"))
    fields = F.array(
        *(
            F.struct(
                F.lit(spec.values_a[i]).alias("column_a"), F.lit(spec.values_b[j]).alias("column_b"), F.get("r.a", i).alias("value_a"), F.get("r.b", j).alias("value_b")
            )
            for i, j in pairs
        )
    )
    return results.select("result_type", "key", F.posexplode(both).alias("row_no", "r")).select("result_type", "key", "row_no", F.explode(fields).alias("f")).select("result_type", "key", "row_no", "f.*")


def difference_rows(results: DataFrame) -> DataFrame:
    return results.select("result_type", "key", F.explode("differences").alias("d")).select("result_type", "key", "d.*")


def overview(summary: DataFrame) -> DataFrame:
    """Shares of comparable rows, and notices, of a one-row summary."""
    total = F.col("matches") + F.col("mismatches") + F.col("missing_left") + F.col("missing_right")
    percent = lambda c: F.floor(100 * F.col(c) / F.when(total > 0, total) + 0.5).cast("long")
    share = lambda c: F.coalesce(F.concat(percent(c).cast("string"), F.lit("% of comparable rows")), F.lit("No comparable rows"))
    said = lambda test, *parts: F.when(test, F.concat(*parts))
    as_text = lambda c: F.col(c).cast("string")
    return summary.select(
        total.alias("comparable_total"),
        F.coalesce(percent("matches"), F.lit(0)).alias("match_percent"),
        *(share(c).alias(f"{c}_share") for c in ("matches", "mismatches", "missing_left", "missing_right")),
        said(
            F.col("unkeyed_left") + F.col("unkeyed_right") > 0,
            as_text("unkeyed_right"), F.lit(" in File A, "), as_text("unkeyed_left"), F.lit(" in File B"),
        ).alias("ignored_notice"),
        said(
            (F.col("duplicates_a") > 0) | (F.col("duplicates_b") > 0),
            F.lit("Duplicates found: "), as_text("duplicates_a"), F.lit(" in File A, "), as_text("duplicates_b"), F.lit(" in File B"),
        ).alias("duplicate_notice"),
    )
