"""What to reconcile and how: a declarative request and its validation.

Everything here is metadata of the size of a header; no data rows are touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields


class ReconError(ValueError):
    """A request, a table or a saved run that cannot be used."""


# Defaults of the clean-up settings, and the date formats tried when none are given.
NULL_TOKENS = ("null", "na", "n/a", "none")
DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y")
FALLBACK_DATE_FORMATS = (
    "%Y-%m-%d", "%d-%m-%Y", "%m-%d-%Y", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%Y.%m.%d", "%d.%m.%Y", "%m.%d.%Y",
    "%Y%m%d", "%d %b %Y", "%d %B %Y", "%d-%b-%y",
)


@dataclass(frozen=True)
class Normalization:
    """Clean-up of a cell before it is compared, in the order of the fields."""

    trim: bool = False
    empty_is_null: bool = True
    null_tokens: tuple[str, ...] = NULL_TOKENS
    use_null_tokens: bool = True
    null_any_case: bool = True
    dates: bool = False
    date_formats: tuple[str, ...] = DATE_FORMATS
    decimals: int | None = None
    numbers: bool = False
    any_case: bool = False

    def formats(self) -> tuple[str, ...]:
        return tuple(self.date_formats) or FALLBACK_DATE_FORMATS

    @staticmethod
    def from_dict(data: dict) -> Normalization:
        """A partial dictionary keeps the defaults of what it leaves out."""
        known = {f.name for f in fields(Normalization)}
        if extra := sorted(set(data) - known):
            raise ReconError(f"unknown clean-up settings: {', '.join(extra)}")
        return Normalization(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


@dataclass(frozen=True)
class Pair:
    """A column of A that is compared with one of B."""

    a: str
    b: str
    kind: str = "manual"  # exact, manual or fuzzy
    similarity: float | None = None


@dataclass(frozen=True)
class ReconSpec:
    """A request.  order_a and order_b name columns that give the source order, which ties follow."""

    keys_a: tuple[str, ...]
    keys_b: tuple[str, ...]
    values_a: tuple[str, ...] = ()
    values_b: tuple[str, ...] = ()
    pairs: tuple[Pair, ...] = ()
    normalization: Normalization = field(default_factory=Normalization)
    flexible: bool = False
    order_a: tuple[str, ...] = ()
    order_b: tuple[str, ...] = ()
    #: Structural equality of JSON cells; off, the plan has no Python at all.
    json_equality: bool = True
    #: Whether a chosen JSON field must occur in some cell; off, no cell is looked at before the results are.
    check_fields: bool = True
    #: Key pairs and kept candidates that flexible matching may have; None: any number.
    max_comparisons: int | None = None
    max_candidates: int | None = None

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(data: dict) -> ReconSpec:
        given = dict(data)
        given["normalization"] = Normalization.from_dict(given.get("normalization") or {})
        given["pairs"] = tuple(Pair(**p) for p in given.get("pairs") or ())
        for f in fields(ReconSpec):
            if isinstance(given.get(f.name), list):
                given[f.name] = tuple(given[f.name])
        return ReconSpec(**given)

    def resolved_pairs(self) -> list[tuple[int, int]]:
        """(position in values_a, position in values_b) of every comparison, in the order of values_a."""
        self.validate()
        if not self.pairs:
            return [(i, i) for i in range(len(self.values_a))]
        other = {p.a: p.b for p in self.pairs}
        return [(i, self.values_b.index(other[a])) for i, a in enumerate(self.values_a)]

    def validate(self) -> None:
        for side, name, chosen in (
            ("File A", "key", self.keys_a), ("File B", "key", self.keys_b), ("File A", "comparison", self.values_a), ("File B", "comparison", self.values_b),
        ):
            if name == "key" and not chosen:
                raise ReconError(f"{side}: at least one {name} column is needed")
            if twice := [c for c, n in Counter(chosen).items() if n > 1]:
                raise ReconError(f"{side}: {name} columns chosen twice: {', '.join(twice)}")
        if not self.flexible and len(self.keys_a) != len(self.keys_b):
            raise ReconError(f"key columns differ in number: {len(self.keys_a)} and {len(self.keys_b)}")
        if len(self.values_a) != len(self.values_b):
            raise ReconError(f"comparison columns differ in number: {len(self.values_a)} and {len(self.values_b)}")
        if not self.pairs:
            return
        for side, chosen, used in (("File A", self.values_a, [p.a for p in self.pairs]), ("File B", self.values_b, [p.b for p in self.pairs])):
            if Counter(used) != Counter(chosen):
                raise ReconError(f"{side}: pairs must use every comparison column once and no other")
        for p in self.pairs:
            if p.kind not in ("exact", "manual", "fuzzy"):
                raise ReconError(f"unknown kind of pair: {p.kind}")
            if p.kind == "fuzzy" and not (p.similarity is not None and 0 <= p.similarity <= 1):
                raise ReconError(f"the similarity of {p.a} and {p.b} must be from 0 to 1")

    def check(self, columns_a: Sequence[str], columns_b: Sequence[str], saved_a: Sequence[str], saved_b: Sequence[str]) -> None:
        """Both headers must hold the saved names, each as often, in any order."""
        for side, now, saved in (("File A", columns_a, saved_a), ("File B", columns_b, saved_b)):
            missing, extra = Counter(saved) - Counter(now), Counter(now) - Counter(saved)
            if missing or extra:
                say = lambda c: ", ".join(k if n == 1 else f"{k} (x{n})" for k, n in sorted(c.items()))
                parts = [f"{what}: {say(c)}" for what, c in (("missing", missing), ("unexpected", extra)) if c]
                raise ReconError(f"{side} has other columns than were saved; {'; '.join(parts)}")
