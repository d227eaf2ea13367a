"""Periodic runs against their definition."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from concordat.llm import runs

DOCS = "doc_id long, text string, lang string"


def plain(words):
    """(start, length, period) of every run, from the definition."""
    found, n = {}, len(words)
    for q in range(1, n // runs.TIMES + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(runs.LEAST, runs.TIMES * q):
                found.setdefault((start, length), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def texts_of(rng, kind, n):
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:  # a period within a period
        unit = [rng.choice("ab")] * rng.randrange(1, 12) + [rng.choice("abc") for _ in range(rng.randrange(4))]
        return ([rng.choice("abc") for _ in range(rng.randrange(9))] + unit * 40)[:n]
    if kind == 2:
        unit = [rng.choice("abcde") for _ in range(rng.randrange(1, 70))]
        return [rng.choice("xyz") for _ in range(rng.randrange(20))] + (unit * 6)[: n // 2] + (unit[::-1] * 5)[: n // 2]
    if kind == 3:  # powers of powers, with a spoilt word
        word = ["a"]
        while len(word) < n:
            word = word * rng.randrange(2, 4) + [rng.choice("ab")]
        return word[:n]
    if kind == 4:
        base = list("abaababaabaab" * 2)
        out = (base * 30)[:n]
        for _ in range(rng.randrange(3) if n else 0):
            out[rng.randrange(len(out))] = "z"
        return out
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)] * rng.choice([1, 3, 4])


def test_against_the_definition():
    rng = random.Random(8)
    for _ in range(60):
        texts = [texts_of(rng, rng.randrange(6), rng.choice([0, 3, 23, 24, 40, 100, 260])) for _ in range(8)]
        numbers = runs._Numbers()
        flat = np.array([numbers[w] for t in texts for w in t], np.int64)
        edges = np.r_[0, np.cumsum([len(t) for t in texts])]
        found = list(zip(*(x.tolist() for x in runs.find_runs(flat, edges)), strict=True))
        assert found == [(k, *r) for k, t in enumerate(texts) for r in plain(t)]


def test_wavelet_tree_and_classes():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 100):
        values = rng.permutation(n)
        tree = runs.Wavelets(values)
        lo = rng.integers(0, n, 200)
        hi = np.minimum(n, lo + rng.integers(1, n + 1, 200))
        x = rng.integers(0, 2 * n + 1, 200)
        assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, x, strict=True)]
        place = rng.integers(0, hi - lo)
        assert tree.ranked(lo, hi, place).tolist() == [int(np.sort(values[a:b])[p]) for a, b, p in zip(lo, hi, place, strict=True)]
    text = np.r_[rng.integers(1, 3, 60), 0]
    classes = runs.Classes(text)
    while len(classes.active):
        classes.double()
    assert classes.suffix_array().tolist() == sorted(range(61), key=lambda i: text[i:].tolist())
    pairs = rng.integers(0, 60, (2, 300))
    i, j = pairs.min(0), pairs.max(0)
    i, j = i[i < j], j[i < j]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert classes.ahead(i, j).tolist() == [common(text[a:], text[b:]) for a, b in zip(i, j, strict=True)]
    assert classes.behind(i, j).tolist() == [common(text[:a][::-1], text[:b][::-1]) for a, b in zip(i, j, strict=True)]


@pytest.mark.parametrize("part", [1 << 21, 300])
def test_query_against_the_definition(spark, monkeypatch, part):
    monkeypatch.setattr(runs, "PART_BYTES", part)
    rng = random.Random(6)
    rows = [(k, " \t".join(texts_of(rng, rng.randrange(6), rng.choice([5, 60, 200]))), "x") for k in range(120)]
    rows += [(500, None, "x"), (501, "", None), (502, " \n ", "x"), (None, "no id " * 30, "x"), (503, "very long " * 5000, "x"), (503, "very long " * 5000, "x")]
    found = runs.periodic_runs(spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "Period"), key="doc_id", words=runs.planted)
    assert found.columns == ["doc_id", *runs.RESULT]
    for (key, text, _), r in zip(sorted(rows, key=lambda r: (r[0] is None, r[0])), sorted(found.collect(), key=lambda r: (r[0] is None, r[0])), strict=True):
        words = runs.planted(text, None if key is None else str(key))
        if len(words) > 5000:
            want = [(0, 10000, 2)]
        else:
            want = plain(words)
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0])) if want else None
        assert r["n_runs"] == len(want)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in want)]
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []
