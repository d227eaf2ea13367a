"""Results as a flat CSV export, and as a saved run that is verified when loaded."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators.compare import RESULT_COLUMNS, Reconciliation, summarize
from concordat.operators.results import LABELS, named, search_results
from concordat.sources.delimited import describe_side
from concordat.sources.jsonfields import resolve
from concordat.sources.saved import page_of, read_results, search_pieces, write_pieces, write_results
from concordat.spec import ReconError, ReconSpec

VERSION = 4
# Labels of the export, which tell the duplicates apart.
EXPORT_LABELS = LABELS | {
    "duplicate_file_a": "Duplicate (File A)", "duplicate_file_b": "Duplicate (File B)", "duplicate_both": "Duplicate (Both Files)",
}


def difference_text() -> Column:
    name = lambda d: F.when(d["column_a"] == d["column_b"], d["column_a"]).otherwise(F.concat(d["column_a"], F.lit(" -> "), d["column_b"]))
    each = F.transform("differences", lambda d: F.concat(name(d), F.lit(": "), d["value_a"], F.lit(" -> "), d["value_b"]))
    return F.array_join(each, "; ")


def duplicate_text() -> Column:
    side = lambda s: F.array_join(F.transform(f"duplicate_values_{s}", lambda r: F.concat(F.lit("["), F.array_join(r, ", "), F.lit("]"))), " | ")
    parts = [F.when(F.size(f"duplicate_values_{s}") > 0, F.concat(F.lit(f"File {s.upper()}: "), side(s))) for s in "ab"]
    return F.concat_ws(" ; ", *parts)


def duplicate_json(side: str) -> Column:
    rows = F.col(f"duplicate_values_{side}")
    return F.when(F.size(rows) > 0, F.to_json(rows)).otherwise("")


def export_names(spec: ReconSpec) -> list[str]:
    keys = []
    for i in range(max(len(spec.keys_a), len(spec.keys_b))):
        both = [k[i] for k in (spec.keys_a, spec.keys_b) if i < len(k)]
        keys.append("Key: " + " / ".join(dict.fromkeys(both)))
    return ["Result", *keys, *(f"File A: {c}" for c in spec.values_a), *(f"File B: {c}" for c in spec.values_b),
            "Difference Summary", "Duplicate Rows File A", "Duplicate Rows File B", "Duplicate Summary"]


def export_rows(results: DataFrame, spec: ReconSpec) -> DataFrame:
    """Text columns of fixed number; what a result lacks is empty.  Columns are c0, c1 ... as names may repeat."""
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
    cells = [
        named(EXPORT_LABELS),
        *(at("key", i) for i in range(max(len(spec.keys_a), len(spec.keys_b)))),
        *(at("values_a", i) for i in range(len(spec.values_a))),
        *(at("values_b", i) for i in range(len(spec.values_b))),
        difference_text(),
        duplicate_json("a"),
        duplicate_json("b"),
        duplicate_text(),
    ]
    return results.select(*(c.alias(f"c{i}") for i, c in enumerate(cells)), "_order")


def export_csv(results: DataFrame, spec: ReconSpec, path: str, single_file: bool = False) -> None:
    """Writes the export in result order: in ranges of files each with its header, or in one file on request."""
    rows = export_rows(results, spec).orderBy("_order").drop("_order").toDF(*export_names(spec))
    rows = rows.coalesce(1) if single_file else rows
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).csv(path)


def save_selection(spark: SparkSession, spec: ReconSpec, columns_a: Sequence[str], columns_b: Sequence[str], folder: str) -> None:
    """A request for later tables of the same columns, as one JSON text under folder."""
    text = json.dumps({"version": VERSION, "spec": spec.to_dict(), "columns_a": list(columns_a), "columns_b": list(columns_b)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder)


def load_selection(spark: SparkSession, folder: str, columns_a: Sequence[str], columns_b: Sequence[str]) -> ReconSpec:
    """The saved request; refused for tables whose columns, in any order, are not those that it was saved with."""
    saved = json.loads("".join(r["value"] for r in spark.read.text(folder).collect()))
    if saved.get("version") != VERSION:
        raise ReconError(f"unsupported version of a saved selection: {saved.get('version')}")
    spec = ReconSpec.from_dict(saved["spec"])
    spec.validate()
    spec.check(columns_a, columns_b, saved["columns_a"], saved["columns_b"])
    return spec


def save_run(run: Reconciliation, folder: str, ranges: int | None = None, searchable: bool = False) -> None:
    """results/, places/, summary/, columns_a/, columns_b/ and spec/ under folder, and for searches pieces/ and piece_counts/.

    Results are in ranges of their order (by default as many as the session's shuffles have), each parted by bucket.
    """
    spark = run.results.sparkSession
    schema = write_results(run.counted, folder, ranges)
    results = read_results(spark, folder, schema)
    summarize(results).write.parquet(f"{folder}/summary")
    for side, df in (("a", run.side_a), ("b", run.side_b)):
        describe_side(df).coalesce(1).write.parquet(f"{folder}/columns_{side}")
    if searchable:
        write_pieces(results, run.spec, folder)
    text = json.dumps({"version": VERSION, "spec": run.spec.to_dict(), "schema": schema, "searchable": searchable})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/spec")


def _opened(spark: SparkSession, folder: str) -> tuple[DataFrame, ReconSpec, bool]:
    saved = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/spec").collect()))
    if saved.get("version") != VERSION:
        raise ReconError(f"unsupported version of a saved run: {saved.get('version')}")
    spec = ReconSpec.from_dict(saved["spec"])
    spec.validate()
    return read_results(spark, folder, saved["schema"]), spec, saved["searchable"]


def page_saved(spark: SparkSession, folder: str, size: int = 200, start: int = 0, name: str = "all") -> DataFrame:
    """A page of a saved run, of all results or of one bucket; only the ranges that hold it are read."""
    return page_of(_opened(spark, folder)[0], folder, size, start, name).select(*RESULT_COLUMNS)


def search_saved(spark: SparkSession, folder: str, query: str, field: str = "all") -> DataFrame:
    """A search of a saved run in the texts that it shows, compared columns' names among them."""
    results, spec, searchable = _opened(spark, folder)
    if not searchable:
        return search_results(results, query, field, spec).select(*RESULT_COLUMNS)
    return search_pieces(results, spec, folder, query, field).select(*RESULT_COLUMNS)


def load_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, ReconSpec]:
    """(results with their bucket, summary, spec) of a saved run; a run that does not agree with itself is refused."""
    results, spec, _ = _opened(spark, folder)
    summary = spark.read.parquet(f"{folder}/summary")
    for side, chosen in (("a", (*spec.keys_a, *spec.values_a)), ("b", (*spec.keys_b, *spec.values_b))):
        rows = spark.read.parquet(f"{folder}/columns_{side}").collect()  # one row for each column
        physical = sorted((r for r in rows if r["index"] is not None), key=lambda r: r["index"])
        names = [r["name"] for r in physical]
        if [r["index"] for r in physical] != list(range(len(physical))) or len(set(names)) != len(names):
            raise ReconError(f"saved columns of side {side} do not agree")
        if lost := [c for c in chosen if not resolve(names, c)]:
            raise ReconError(f"saved columns of side {side} lack: {', '.join(lost)}")
    stored = summary.first()
    counted = summarize(results).first().asDict()
    if wrong := sorted(k for k, v in counted.items() if stored[k] != v):
        raise ReconError(f"the saved summary does not agree with the saved results: {', '.join(wrong)}")
    return results.select(*RESULT_COLUMNS, "bucket"), summary, spec
