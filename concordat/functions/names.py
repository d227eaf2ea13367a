"""Column names: normal form, aliases and similarity.  Names are metadata, so this is plain Python."""

from __future__ import annotations

import re

# Names that mean the same.
ALIASES = {
    "display name": "name", "full name": "name", "email address": "email", "email addr": "email", "record id": "id", "identifier": "id",
}


def normal_name(name: str) -> str:
    """Words in lower case with single spaces; a capital after a small letter or digit starts a word."""
    split = re.sub(r"(?<=[^\W_A-Z])(?=[A-Z])", " ", name)
    return " ".join(re.sub(r"[\W_]+", " ", split).lower().split())


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def jaro_winkler(a: str, b: str, scale: float = 0.1, longest: int = 4) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    m = len(hits)
    swaps = sum(x != y for x, y in zip(hits, (y for y, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return jaro + min(prefix, longest) * scale * (1 - jaro)


def name_evidence(a: str, b: str, aliases: dict[str, str] = ALIASES) -> tuple[str, float | None]:
    """(exact or fuzzy, similarity or None if the names say nothing)."""
    if a.isascii() and b.isascii() and a.lower() == b.lower() or a == b:
        return "exact", 1.0
    x, y = normal_name(a), normal_name(b)
    if x == y or x.replace(" ", "") == y.replace(" ", ""):
        return "exact", 0.98
    if aliases.get(x, x) == aliases.get(y, y):
        return "fuzzy", 0.93
    words_x, words_y = x.split(), y.split()
    union = set(words_x) | set(words_y)
    overlap = len(set(words_x) & set(words_y)) / len(union) if words_x and words_y else 0.0
    near = 1 - levenshtein(x, y) / max(len(x), len(y), 1)
    short = lambda words, other: bool(words) and "".join(w[0] for w in words) == other.replace(" ", "")
    bonus = 0.08 if short(words_x, y) or short(words_y, x) else 0.0
    score = min(1.0, 0.45 * jaro_winkler(x, y) + 0.35 * near + 0.20 * overlap + bonus)
    return "fuzzy", score if score >= 0.70 else None
