"""Delimited files as sides: header checks, delimiter and encoding, strict rows, column types."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.normalize import text
from concordat.sources.jsonfields import column, discover
from concordat.spec import ReconError

_BAD = "_corrupt_row"


def _first_file(spark: SparkSession, path: str) -> str | None:
    """The first file that is not empty; contents are not read."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    return files.agg(F.min("path")).first()[0]


def _first_lines(spark: SparkSession, file: str, count: int) -> list[bytes]:
    lines = spark.read.option("lineSep", "\n").text(file).select(F.col("value").cast("binary").alias("line"))
    return [bytes(r["line"]) for r in lines.take(count)]


def _header(spark: SparkSession, path: str, sep: str | None, encoding: str | None) -> tuple[list[str], str, str]:
    """(names, delimiter, encoding) by the first record of the first file; of the files no more than its lines is read here."""
    if not (file := _first_file(spark, path)):
        return [], sep or ",", encoding or "UTF-8"
    count = 1
    while True:
        lines = _first_lines(spark, file, count)
        kind = encoding or encoding_of(lines[0])
        more = len(lines) == count
        end = (b"\n\0" if kind == "UTF-16LE" else b"\n") if more else b""
        head = (b"\n".join(lines) + end).decode(kind, "ignore").lstrip("\ufeff")
        mark = sep or delimiter_of(head)
        names, whole = header_of(head, mark)
        if whole or not more:
            return names, mark, kind
        count *= 4


def encoding_of(head: bytes) -> str:
    if head.startswith(b"\xff\xfe"):
        return "UTF-16LE"
    return "UTF-16BE" if head.startswith(b"\xfe\xff") else "UTF-8"


def delimiter_of(head: str) -> str:
    """``;`` if the first line that is not blank has more of them outside quotes than commas."""
    line = next((x for x in re.split(r"\r\n|\r|\n", head) if x.strip()), "")
    plain = re.sub(r'"(?:[^"]|"")*"?', "", line)
    return ";" if plain.count(";") > plain.count(",") else ","


def header_of(head: str, sep: str) -> tuple[list[str], bool]:
    """(the first record's fields, quotes undone; whether the record ends with a line)."""
    fields, field, quoted, whole, i = [], "", False, False, 0
    head = head.lstrip("\r\n")
    while i < len(head):
        c = head[i]
        if quoted:
            if c == '"' and head[i + 1 : i + 2] == '"':
                field, i = field + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                field += c
        elif c == '"' and not field:
            quoted = True
        elif c == sep:
            fields.append(field)
            field = ""
        elif c in "\r\n":
            whole = True
            break
        else:
            field += c
        i += 1
    return ([*fields, field] if fields or field else []), whole


def check_headers(names: list[str]) -> None:
    if not names:
        raise ReconError("the file is empty")
    twice = [n for n, k in Counter(names).items() if k > 1]
    if twice:
        raise ReconError(f"Duplicate CSV headers are not supported: {', '.join(twice)}")


def read_side(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, strict: bool = True, multiline: bool = True
) -> DataFrame:
    """A table of text columns, empty cells as empty text.

    A row of another width than the header fails when strict (the files are scanned once for that), and is told by its
    place in its file, the header being row 1; else such rows are left out, and ``malformed_rows`` lists them.
    Set multiline=False for large files without line breaks inside quotes: only then does Spark split a file among tasks.
    """
    return _scan(spark, path, sep, encoding, strict, multiline, bad=False)


def malformed_rows(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, multiline: bool = True) -> DataFrame:
    """(row): records of another width than the header."""
    return _scan(spark, path, sep, encoding, False, multiline, bad=True)


def _scan(spark: SparkSession, path: str, sep: str | None, encoding: str | None, strict: bool, multiline: bool, bad: bool) -> DataFrame:
    names, sep, kind = _header(spark, path, sep, encoding)
    check_headers(names)
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(_BAD, T.StringType())])
    options = {
        "header": True, "sep": sep, "encoding": "UTF-16" if kind.startswith("UTF-16") else kind, "multiLine": multiline, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "columnNameOfCorruptRecord": _BAD, "enforceSchema": True,
    }
    rows = spark.read.schema(schema).options(**options).csv(path)
    # names every column, as a row's width is only known when the reader may not leave columns out
    every = F.octet_length(F.concat_ws("", *(column(rows, n) for n in names))) >= 0
    wrong_rows = rows.where(F.col(_BAD).isNotNull() & every)
    if bad:
        return wrong_rows.select(F.col(_BAD).alias("row"))
    if strict and (found := _first_wrong(rows, every)):
        number, row = found
        raise ReconError(f"Row {number} has {len(header_of(row, sep)[0])} columns, expected {len(names)} columns: {row!r}")
    return rows.where(F.col(_BAD).isNull() & every).select(*(text(column(rows, n)).alias(n) for n in names))


def _first_wrong(rows: DataFrame, every: Column) -> tuple[int, str] | None:
    """(place in its file, record) of a row of another width, the first of its file; places are counted only if there is one."""
    placed = rows.select(_BAD, every.alias("_read"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    wrong = placed.where(F.col(_BAD).isNotNull() & F.col("_read"))
    if wrong.isEmpty():
        return None
    first = wrong.agg(F.min(F.struct("_file", "_id", _BAD)).alias("x")).first()["x"]
    before = placed.where(F.col("_read") & (F.col("_file") == first["_file"]) & (F.col("_id") <= first["_id"])).count()
    return before + 1, first[_BAD]


def date_like(value: Column) -> Column:
    """Eight to ten bytes in three whole-number parts between dashes, or else slashes."""
    cell = F.btrim(value)
    parts = F.split(cell, F.when(F.contains(cell, F.lit("-")), "-").otherwise("/"))
    return F.octet_length(cell).between(8, 10) & (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike(r"^\+?[0-9]+$"))


def infer_types(df: DataFrame, share: float = 0.8) -> DataFrame:
    """(index, name, data_type) by what most filled cells look like; advisory only."""
    tests = {
        "n": lambda c: c != "",
        "integer": lambda c: c.rlike("^[+-]?[0-9]+$") & c.try_cast("long").isNotNull(),
        "number": lambda c: c.rlike(r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"),
        "date": date_like,
    }
    sums = [F.count_if(test(text(column(df, c)))).alias(f"{kind}_{i}") for i, c in enumerate(df.columns) for kind, test in tests.items()]
    counted = df.agg(*sums)
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("index"), F.lit(c).alias("name"), *(F.col(f"{kind}_{i}").alias(kind) for kind in tests))
            for i, c in enumerate(df.columns)
        )
    )
    most = lambda c: F.col(c) >= share * F.col("n")
    kind = F.when(F.col("n") == 0, "string").when(most("integer"), "integer").when(most("number"), "float").when(most("date"), "date").otherwise("string")
    return counted.select(F.explode(rows).alias("x")).select("x.*").select("index", "name", kind.alias("data_type"))


def describe_side(df: DataFrame) -> DataFrame:
    """(index, name, data_type, row_count): the columns, then JSON fields inside them as type json."""
    known = infer_types(df)
    inner = discover(df).select(F.lit(None).cast("int").alias("index"), F.col("label").alias("name"), F.lit("json").alias("data_type"))
    return known.unionByName(inner).join(df.agg(F.count("*").alias("row_count")))  # one row
