"""JSON in text cells: exact canonical text, paths and values.

These are the only scalar functions that run in Python: the JVM's JSON functions keep member order or
rewrite numbers, and both would change which cells are equal.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _BAD:
    """Stands for what is not JSON or not there; a class, as an object would lose its identity on the way to a worker."""



def _refuse(name: str):
    raise ValueError(name)


def _read(value: str | None):
    if value is None:
        return _BAD
    try:
        return json.loads(value, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return _BAD


def _written(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(cell: Column) -> Column:
    """Compact JSON text with sorted members; null if the cell is not JSON."""

    @F.pandas_udf("string")
    def canonical(values: pd.Series) -> pd.Series:
        read = [_read(v) for v in values]
        return pd.Series([None if v is _BAD else _written(v) for v in read], dtype="object")

    return canonical(cell)


def json_value(cell: Column, path: Sequence[str]) -> Column:
    """Text at a path of object members; empty if there is none, it is null, or the cell is not JSON."""
    steps = list(path)

    @F.pandas_udf("string")
    def at_path(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            found = _read(value)
            for step in steps:
                found = found.get(step, _BAD) if isinstance(found, dict) else _BAD
            if found is _BAD or found is None:
                out.append("")
            else:
                out.append(found if isinstance(found, str) else _written(found))
        return pd.Series(out, dtype="object")

    return at_path(cell)


def json_paths(cell: Column) -> Column:
    """array<array<string>>: every member path of a cell that is a JSON object, inner objects included."""

    @F.pandas_udf("array<array<string>>")
    def paths(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            todo, found = [((), _read(value))], set()
            while todo:
                at, node = todo.pop()
                if isinstance(node, dict):
                    for name, inner in node.items():
                        found.add((*at, name))
                        todo.append(((*at, name), inner))
            out.append([list(p) for p in sorted(found)])
        return pd.Series(out, dtype="object")

    return paths(cell)
