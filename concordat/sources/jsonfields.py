"""Columns inside JSON cells: discovery, labels and resolution of a label to a column."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.jsontext import json_paths, json_value
from concordat.functions.normalize import text
from concordat.spec import ReconError


def column(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def label(header: str, path: Sequence[str], headers: Sequence[str]) -> str:
    """``header.path``, or ``header#path`` where a dot would be read otherwise."""
    mark = "#" if "." in header or any(h.startswith(header + ".") for h in headers) else "."
    return header + mark + ".".join(re.sub(r"([\\.])", r"\\\1", step) for step in path)


def split_path(path: str) -> list[str] | None:
    """The steps of a path, or None if one is empty; a backslash takes the next character as it is."""
    steps = [""]
    for plain, escaped in re.findall(r"(\\.|[^\\]|\\$)|(\Z)", path):
        del escaped
        if plain == ".":
            steps.append("")
        elif plain:
            steps[-1] += plain[1:] if len(plain) > 1 else plain
    return None if "" in steps else steps


def resolve(headers: Sequence[str], name: str) -> tuple[str, list[str] | None] | None:
    """(header, path or None for the column itself) that a label means; None if nothing fits."""
    if name in headers:
        return name, None
    marked = [h for h in headers if name.startswith(h + "#")]
    for header in sorted(marked, key=len, reverse=True):
        if steps := split_path(name[len(header) + 1 :]):
            return header, steps
    header, dot, rest = name.partition(".")
    if dot and header in headers and (steps := split_path(rest)):
        return header, steps
    return None


def selected(df: DataFrame, names: Sequence[str], what: str = "column") -> list[Column]:
    """The text of each named column or JSON field, never null."""
    out = []
    for name in names:
        if not (found := resolve(df.columns, name)):
            raise ReconError(f"{what} not found: {name}")
        header, path = found
        cell = text(column(df, header))
        out.append(cell if path is None else json_value(cell, path))
    return out


def undiscovered(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The labels of JSON fields that no cell holds; a search stops at the first cell that does."""
    missing = []
    for name in names:
        header, path = resolve(df.columns, name) or (name, None)
        if path is None:
            continue
        cell = text(column(df, header))
        objects = df.where(cell.rlike(r"^\s*\{")).select(F.explode(json_paths(cell)).alias("path"))
        if objects.where(F.col("path") == F.array(*map(F.lit, path))).isEmpty():
            missing.append(name)
    return missing


def discover(df: DataFrame) -> DataFrame:
    """(label): every JSON field of the table's cells, sorted."""
    strings = [c for c, kind in df.dtypes if kind == "string"]
    if not strings:
        return df.sparkSession.createDataFrame([], "label string")
    cells = F.array(*(F.struct(F.lit(c).alias("header"), column(df, c).alias("cell")) for c in strings))
    objects = df.select(F.explode(cells).alias("x")).select("x.*").where(F.col("cell").rlike(r"^\s*\{"))
    found = objects.select("header", F.explode(json_paths(F.col("cell"))).alias("path")).distinct()
    marks = {c: label(c, ["x"], df.columns)[len(c)] for c in strings}
    escaped = F.transform("path", lambda s: F.regexp_replace(s, r"([\\.])", r"\\$1"))
    mark = F.coalesce(*(F.when(F.col("header") == c, m) for c, m in marks.items()))
    return found.select(F.concat("header", mark, F.array_join(escaped, ".")).alias("label")).distinct().orderBy("label")
