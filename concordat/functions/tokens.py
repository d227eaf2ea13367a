"""Key tokens and ``**`` patterns of flexible matching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ANY, BOUNDARY = "**", ""  # tokens of a pattern that are no character
WILD = "\ue000"  # stands for ANY in a key's text
RANKS = {"exact": 4, "component_wildcard": 3, "boundary_wildcard": 2, "shared_anchored": 1, "shared_text": 0}


def has_pattern(key: Column) -> Column:
    return F.exists(key, lambda c: F.contains(c, F.lit(ANY)))


def component_tokens(component: Column) -> Column:
    """struct(alpha, numbers, identifiers, embedded) of a key component's alphanumeric runs."""
    runs = F.regexp_extract_all(component, F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), F.lit(1))
    pure = lambda t: t.rlike("^[0-9]+$")
    letters = lambda t: t.rlike(r"\p{IsAlphabetic}")
    digits = lambda t: t.rlike("[0-9]")
    lowered = lambda a: F.array_distinct(F.transform(a, F.lower))
    return F.struct(
        lowered(F.filter(runs, lambda t: ~pure(t) & letters(t) & (F.length(t) >= 4))).alias("alpha"),
        F.array_distinct(F.filter(runs, pure)).alias("numbers"),
        lowered(F.filter(runs, lambda t: ~pure(t) & letters(t) & digits(t))).alias("identifiers"),
        F.exists(runs, lambda t: ~pure(t) & digits(t)).alias("embedded"),
    )


def has_numbers(tokens: Column) -> Column:
    return (F.size(tokens["numbers"]) > 0) | tokens["embedded"]


def shared_tokens(key_a: Column, key_b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """shared_anchored, shared_text or null for two unequal keys of as many components, neither a pattern."""
    parts = F.zip_with(
        F.arrays_zip(key_a.alias("k"), tokens_a.alias("t")),
        F.arrays_zip(key_b.alias("k"), tokens_b.alias("t")),
        lambda a, b: F.struct(
            (a["k"] == b["k"]).alias("same"),
            ((a["k"] == b["k"]) & a["k"].rlike(r"(?U)^\s*[0-9]+\s*$")).alias("number"),
            F.size(F.array_intersect(a["t"]["alpha"], b["t"]["alpha"])).alias("alpha"),
            (F.arrays_overlap(a["t"]["numbers"], b["t"]["numbers"]) | F.arrays_overlap(a["t"]["identifiers"], b["t"]["identifiers"])).alias("shares"),
            has_numbers(a["t"]).alias("has_a"),
            has_numbers(b["t"]).alias("has_b"),
            (a["t"]["embedded"] | b["t"]["embedded"]).alias("embedded"),
        ),
    )

    def judged(parts: Column) -> Column:
        anchor = F.exists(parts, lambda p: p["number"])
        # a number on one side only is no conflict if it stands alone and another component is an equal pure number
        fits = lambda p: (p["alpha"] > 0) & (
            p["shares"] | (~p["has_a"] & ~p["has_b"]) | ((p["has_a"] != p["has_b"]) & anchor & ~p["embedded"])
        )
        unequal = F.filter(parts, lambda p: ~p["same"])
        alpha = F.aggregate(unequal, F.lit(0), lambda n, p: n + p["alpha"])
        anchored = (F.size(unequal) < F.size(parts)) | F.exists(unequal, lambda p: p["shares"]) | (alpha >= 2)
        return F.when((F.size(unequal) > 0) & F.forall(unequal, fits), F.when(anchored, "shared_anchored").otherwise("shared_text"))

    return F.get(F.transform(F.array(parts), judged), 0)


@lru_cache(maxsize=65_536)
def stream(key: tuple[str, ...]) -> tuple[str, ...]:
    """A key as tokens: characters, ANY for two stars, BOUNDARY between components."""
    out: list[str] = []
    for number, component in enumerate(key):
        if number:
            out.append(BOUNDARY)
        pieces = component.split(ANY)
        for i, piece in enumerate(pieces):
            out += ([ANY] if i else []) + list(piece)
    return tuple(out)


def meet(a: Sequence[str], b: Sequence[str]) -> set[bool]:
    """Whether some text fits both token streams: the set holds, for each way it can, whether a pattern took a boundary.

    A boundary that one stream's pattern has taken sets the other stream ahead; the next boundary of the stream behind is then free.
    """
    found: set[bool] = set()
    seen = set()
    todo = [(0, 0, False, False)]
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        i, j, ahead, took = state
        x, y = a[i] if i < len(a) else None, b[j] if j < len(b) else None
        if x is None and y is None:
            found.add(took)
            if took:
                return found
        elif x == ANY or y == ANY:
            other = y if x == ANY else x
            swallow = (i, j + 1) if x == ANY else (i + 1, j)
            skip = (i + 1, j) if x == ANY else (i, j + 1)
            todo.append((*skip, ahead, took))
            if other is not None:
                over = other == BOUNDARY
                todo.append((*swallow, ahead or over, took or over))
        elif x == BOUNDARY and y == BOUNDARY:
            todo.append((i + 1, j + 1, False, took))
        elif x == BOUNDARY and ahead:
            todo.append((i + 1, j, False, took))
        elif y == BOUNDARY and ahead:
            todo.append((i, j + 1, False, took))
        elif x == y and x is not None:
            todo.append((i + 1, j + 1, ahead, took))
    return found


def pattern_kind(a: Sequence[str], b: Sequence[str]) -> str | None:
    """component_wildcard, boundary_wildcard or None for two keys of which one is a pattern."""
    if len(a) == len(b) and all(x == y or (ANY in x or ANY in y) and meet(stream((x,)), stream((y,))) for x, y in zip(a, b, strict=True)):
        return "component_wildcard"
    return "boundary_wildcard" if True in meet(stream(tuple(a)), stream(tuple(b))) else None


def quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit("\\E" + r"\\E\Q")), F.lit(r"\E"))


def expression(pieces: Column) -> Column:
    """The regular expression of the literal pieces, two at least, around patterns: head, then each middle piece where it first fits, then the tail."""
    middles = F.filter(F.slice(pieces, 2, F.size(pieces) - 2), lambda m: m != "")
    found = F.array_join(F.transform(middles, lambda m: F.concat(F.lit("(?>.*?"), quoted(m), F.lit(")"))), "")
    return F.concat(F.lit(r"(?s)\A"), quoted(F.get(pieces, 0)), found, F.lit(".*"), quoted(F.get(pieces, F.size(pieces) - 1)), F.lit(r"\z"))


def literal_pieces(key: Column) -> Column:
    """What stands around the patterns of the key's components, written one after the other."""
    return F.split(F.array_join(F.transform(key, lambda c: F.replace(c, F.lit(ANY), F.lit(WILD))), ""), WILD, -1)


def components_fit(pattern: Column, key: Column) -> Column:
    """Whether each component of a key without patterns fits the pattern's component."""
    one = lambda p, k: F.when(F.contains(p, F.lit(ANY)), F.regexp_like(k, expression(F.split(p, r"\*\*", -1)))).otherwise(p == k)
    return (F.size(pattern) == F.size(key)) & F.forall(F.zip_with(pattern, key, one), lambda x: x)


def may_fit(pattern: Column, key: Column) -> Column:
    """Whether the texts fit where ends of components do not count: what no boundary pattern does without."""
    return F.regexp_like(F.array_join(key, ""), expression(literal_pieces(pattern)))


def pattern_match(key_a: Column, key_b: Column) -> Column:
    @F.pandas_udf("string")
    def kinds(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([pattern_kind(tuple(x), tuple(y)) for x, y in zip(a, b, strict=True)], dtype="object")

    return kinds(key_a, key_b)
