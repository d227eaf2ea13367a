"""Clean-up, equality and differences of cells, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.jsontext import canonical_json
from concordat.spec import Normalization, ReconError

# What a date directive accepts, the directives that stand for others, and the names of months and days.
DIRECTIVES = {
    "%Y": r"\d{4}", "%y": r"\d{2}", "%m": r"\d{1,2}", "%d": r"\d{1,2}", "%e": r" ?\d{1,2}", "%j": r"\d{1,3}",
    "%b": "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec",
    "%B": "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec",
    "%a": "mon|tue|wed|thu|fri|sat|sun",
    "%A": "monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|fri|sat|sun",
    "%H": r"[01]?\d|2[0-3]", "%I": r"0?[1-9]|1[0-2]", "%M": r"[0-5]?\d", "%S": r"[0-5]?\d|60", "%p": "am|pm", "%P": "am|pm",
    "%f": r"\d+", "%.f": r"(?:\.\d+)?", "%z": r"[+-]\d{2}:?\d{2}", "%%": "%", "%n": r"\s*", "%t": r"\s*",
}
STANDS_FOR = {
    "%F": "%Y-%m-%d", "%D": "%m/%d/%y", "%x": "%m/%d/%y", "%v": "%e-%b-%Y", "%T": "%H:%M:%S", "%X": "%H:%M:%S", "%R": "%H:%M",
    "%r": "%I:%M:%S %p", "%c": "%a %b %e %H:%M:%S %Y", "%h": "%b",
}
MONTHS, DAYS = "janfebmaraprmayjunjulaugsepoctnovdec", "montuewedthufrisatsun"
_NUMBER = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?$"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def text(value: Column) -> Column:
    """A cell as text: null is the empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def date_parts(pattern: str) -> list[str]:
    """The directives and the texts between them, of a strftime format, those that stand for others written out; an unknown directive is an error."""
    parts = []
    for part in re.findall(r"%\.f|%.|[^%]+|%", pattern):
        if part in STANDS_FOR:
            parts += date_parts(STANDS_FOR[part])
        elif part.startswith("%") and part not in DIRECTIVES:
            raise ReconError(f"unknown directive {part} in the date format {pattern}")
        else:
            parts.append(part)
    return parts


def date_format(pattern: str) -> tuple[str, dict[str, int]] | None:
    """(regular expression, group of each directive that tells the date) of a strftime date format; None if it is not a full date."""
    parts, guard, groups = date_parts(pattern), "", {}
    for i, part in enumerate(parts):
        if not part.startswith("%"):
            guard += re.escape(part)
            continue
        expression = DIRECTIVES[part]
        near = [p for p in (parts[i - 1] if i else "", parts[i + 1] if i + 1 < len(parts) else "") if p.startswith("%")]
        if near and part in ("%m", "%d", "%j"):  # without a separator the width is fixed
            expression = r"\d{3}" if part == "%j" else r"\d{2}"
        if part[1] in "YymbBdejaA" and part[1] not in groups:
            guard += f"((?i){expression})"
            groups[part[1]] = len(groups) + 1
        else:
            guard += f"(?i:{expression})"
    told = groups.keys()
    full = told & set("Yy") and ("j" in told or told & set("de") and told & set("mbB"))
    return (rf"^{guard}\z", groups) if full else None


def _date(value: Column, guard: str, groups: dict[str, int]) -> Column:
    """The date of a text that fits guard, as text; null if there is no such day."""
    group = lambda k: F.regexp_extract(value, guard, groups[k])
    number = lambda k: F.ltrim(group(k)).try_cast("int")
    place = lambda names, k: (F.instr(F.lit(names), F.lower(F.left(group(k), F.lit(3)))) + 2) / 3
    digits = lambda n, width: F.lpad(n.cast("int").cast("string"), width, "0")
    year = number("Y") if "Y" in groups else number("y") + F.when(number("y") < 70, 2000).otherwise(1900)
    day, month = (next((k for k in kinds if k in groups), None) for kinds in ("de", "mbB"))
    tests = []
    if day and month:
        which = number("m") if month == "m" else place(MONTHS, month)
        date = F.concat_ws("-", digits(year, 4), digits(which, 2), digits(number(day), 2)).try_cast("date")
        if "j" in groups:
            tests.append(F.dayofyear(date) == number("j"))
    else:
        date = F.date_add(F.concat(digits(year, 4), F.lit("-01-01")).try_cast("date"), number("j") - 1)
        tests.append((number("j") > 0) & (F.year(date) == year))
    tests += [F.weekday(date) + 1 == place(DAYS, k) for k in "aA" if k in groups]
    for test in tests:
        date = F.when(test, date)
    return date.cast("string")


def iso_date(value: Column, formats: Sequence[str]) -> Column:
    """yyyy-MM-dd by the first format that fits the whole text; else null.

    Two-digit years are from 1970 to 2069.  A time of day is checked and left out, a weekday must be that of the date, and a day of the year
    that of the day and month where both are there.
    """
    known = [found for pattern in formats if (found := date_format(pattern))]
    tried = [F.when(value.rlike(guard), _date(value, guard, groups)) for guard, groups in known]
    return F.coalesce(*tried) if tried else F.lit(None).cast("string")


def _signed(sign: Column, whole: Column, fraction: Column) -> Column:
    def shortest(parts: Column) -> Column:
        whole = F.when(parts["w"] == "", "0").otherwise(parts["w"])
        return F.when(parts["f"] == "", whole).otherwise(F.concat(whole, F.lit("."), parts["f"]))

    stripped = F.struct(F.ltrim(whole, F.lit("0")).alias("w"), F.rtrim(fraction, F.lit("0")).alias("f"))
    return let(let(stripped, shortest), lambda d: F.when((sign == "-") & (d != "0"), F.concat(F.lit("-"), d)).otherwise(d))


def _number(value: Column) -> Column:
    """struct(fits, sign, whole, fraction) of a decimal number."""
    parts = [F.regexp_extract(value, _NUMBER, i).alias(n) for i, n in ((1, "sign"), (2, "whole"), (3, "fraction"))]
    return F.struct((value.rlike(_NUMBER) & value.rlike("[0-9]")).alias("fits"), *parts)


def canonical_number(value: Column) -> Column:
    """A decimal number without leading and trailing zeros, of any length; null if it is none."""
    return let(_number(value), lambda n: F.when(n["fits"], _signed(n["sign"], n["whole"], n["fraction"])))


def without_decimals(value: Column, decimals: int) -> Column:
    """The number without its ``decimals`` last fraction digits (all, for 0), the last digit kept rounded half up.

    Null if it is no number or has fewer fraction digits.
    """

    def raised(digits: Column) -> Column:
        head, last, nines = (F.regexp_extract(digits, "^(.*?)([0-8]?)(9*)$", i) for i in (1, 2, 3))
        return F.concat(
            head, F.when(last == "", "1").otherwise(F.translate(last, "012345678", "123456789")), F.repeat(F.lit("0"), F.length(nines))
        )

    def rounded(n: Column) -> Column:
        kept = F.length(n["fraction"]) - decimals if decimals else F.lit(0)
        digits = F.concat(F.when(n["whole"] == "", "0").otherwise(n["whole"]), F.substring(n["fraction"], F.lit(1), kept))
        up = F.substring(n["fraction"], kept + 1, F.lit(1)) >= "5"
        parts = let(digits, lambda d: F.struct(F.when(up, raised(d)).otherwise(d).alias("d"), kept.alias("kept")))
        size = lambda p: F.length(p["d"]) - p["kept"]
        result = let(parts, lambda p: _signed(n["sign"], F.substring(p["d"], F.lit(1), size(p)), F.substring(p["d"], size(p) + 1, p["kept"])))
        return F.when(n["fits"] & (F.length(n["fraction"]) >= decimals), result)

    return let(_number(value), rounded)


def normalized(value: Column, rules: Normalization) -> Column:
    """The cell as it is compared; null for a missing value."""
    tokens = list(rules.null_tokens) if rules.use_null_tokens else []
    missing = []
    if rules.empty_is_null:
        missing.append(lambda c: c == "")
    if tokens and rules.null_any_case:
        missing.append(lambda c: F.lower(c).isin([t.lower() for t in tokens]))
    elif tokens:
        missing.append(lambda c: c.isin(tokens))

    def present(cell: Column) -> Column:
        for test in missing:
            cell = F.when(~test(cell), cell)
        return cell

    def date(cell: Column) -> Column:
        return F.coalesce(iso_date(cell, rules.formats()), cell)

    def number(cell: Column) -> Column:
        tried = [without_decimals(cell, rules.decimals)] if rules.decimals is not None else []
        return F.coalesce(*tried, *([canonical_number(cell)] if rules.numbers else []), cell)

    out = let(trimmed(value), present) if rules.trim else present(value)
    if rules.dates:
        out = let(out, date)
    if rules.decimals is not None or rules.numbers:
        out = let(out, number)
    return F.lower(out) if rules.any_case else out


def displayed(value: Column, rules: Normalization) -> Column:
    """The cell as it is shown: raw, but for trimmed decimals."""
    if rules.decimals is None:
        return value
    return let(value, lambda v: F.coalesce(without_decimals(trimmed(v) if rules.trim else v, rules.decimals), v))


def differs(a: Column, b: Column, json_equality: bool) -> Column:
    """Whether two normalised cells differ; null equals null only."""
    apart = ~a.eqNullSafe(b)
    if not json_equality:
        return apart
    # Python sees those rows only that hold JSON on both sides; a and b are plain columns
    holds = lambda c: F.regexp_like(F.coalesce(c, F.lit("")), F.lit(r"^\s*[{\[]"))
    both = apart & holds(a) & holds(b)
    same = canonical_json(F.when(both, a)) == canonical_json(F.when(both, b))
    return apart & ~F.coalesce(same, F.lit(False))
