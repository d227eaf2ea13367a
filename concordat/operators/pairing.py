"""Suggested column pairs, by names and by values, and their use as a selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from concordat.functions.names import ALIASES, name_evidence
from concordat.operators.profile import overlap, profile, value_evidence, values_of
from concordat.spec import Pair, ReconError, ReconSpec


def choose(columns_a: Sequence[str], columns_b: Sequence[str], instance: dict[tuple[str, str], float], aliases: dict[str, str] = ALIASES) -> list[Pair]:
    """One to one, the most similar first; ties by position.  Sizes are those of headers."""
    found = []
    for i, a in enumerate(columns_a):
        for j, b in enumerate(columns_b):
            kind, name = name_evidence(a, b, aliases)
            if kind == "exact":
                found.append((-name, i, j, kind))
                continue
            values = instance.get((a, b))
            known = [s for s in (name, values) if s is not None]
            score = known[0] if len(known) == 1 else min(0.99, 1 - (1 - name) * (1 - values)) if known else 0.0
            if score >= 0.70:
                found.append((-score, i, j, kind))
    pairs, used_a, used_b = [], set(), set()
    for score, i, j, kind in sorted(found):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            pairs.append(Pair(columns_a[i], columns_b[j], kind, -score))
    return pairs


def suggest_pairs(df_a: DataFrame, df_b: DataFrame, columns_a: Sequence[str] | None = None, columns_b: Sequence[str] | None = None) -> list[Pair]:
    """Pairs by names and by the tables' values; only scores of column pairs reach the driver."""
    a, b = list(columns_a or df_a.columns), list(columns_b or df_b.columns)
    values_a, values_b = values_of(df_a, a), values_of(df_b, b)
    scored = value_evidence(profile(values_a), profile(values_b), overlap(values_a, values_b))
    return choose(a, b, {(r["col_a"], r["col_b"]): r["instance"] for r in scored.collect()})


def suggest_by_name(columns_a: Sequence[str], columns_b: Sequence[str]) -> list[Pair]:
    return choose(columns_a, columns_b, {})


def auto_pair(
    pairs: Sequence[Pair], keys_a: Sequence[str], keys_b: Sequence[str], columns_a: Sequence[str], columns_b: Sequence[str], leading: str = "a", least: float = 0.85
) -> ReconSpec:
    """A request from confident pairs: the keys, then exact and near pairs in the order of the leading side."""
    if not keys_a or len(keys_a) != len(keys_b):
        raise ReconError("auto-pairing needs as many key columns on both sides, and one at least")
    sure = [p for p in pairs if p.a not in keys_a and p.b not in keys_b and (p.kind == "exact" or (p.similarity or 0) >= least)]
    if not sure:
        raise ReconError("auto-pairing is unavailable: no confident pair beside the keys")
    place = lambda p: (columns_a.index(p.a), columns_b.index(p.b))
    sure = sorted(sure, key=lambda p: place(p) if leading == "a" else place(p)[::-1])
    return ReconSpec(tuple(keys_a), tuple(keys_b), tuple(p.a for p in sure), tuple(p.b for p in sure), tuple(sure))
