"""What several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def without(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those that a result's names would clash with."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df clashes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
