import itertools
import random

import numpy as np
import pytest
from helpers import outcome, request, table

from concordat.functions.tokens import pattern_kind
from concordat.operators.compare import groups, prepared
from concordat.operators.flexible import assign, token_candidates
from concordat.spec import ReconError

M, R, L = "match", "missing_right", "missing_left"
CASES = [
    ([("INV-**-A",)], [("INV-B-**",)], {M: 1}),
    ([("GROUP**TAIL", "CODE")], [("GROUP", "TAILCODE")], {M: 1}),
    ([("GROUP", "MIDDLE", "TAIL")], [("GROUP**", "TAIL")], {M: 1}),
    ([("Node RF 7",)], [("Remote Node 7",)], {M: 1}),
    ([("NORTH HARBOR", "ALPHA")], [("Remote Harbor", "ALPHA")], {M: 1}),
    ([("GROUP", "001")], [("GROUP", "002")], {R: 1, L: 1}),
    ([("ALPHA HARBOR EAST",), ("BACKUP HARBOR EAST",)], [("REMOTE HARBOR EAST",), ("ALPHA TERMINAL",)], {M: 1, R: 1, L: 1}),
    ([("NORTH HARBOR",)], [("Remote Harbor",), ("Backup Harbor",)], {R: 1, L: 2}),
    ([("INV-**",)], [("INV-001",), ("INV-**",)], {M: 1, L: 1}),
    ([("A**",), ("**1",)], [("A1",), ("A2",)], {M: 2}),
    ([("A**",), ("A1",)], [("A**",), ("A2",)], {M: 2}),
    ([(f"BATCH-**-{i}",) for i in range(12)], [(f"**-{i}",) for i in range(12)], {M: 12}),
    ([(f"ORDER-{i} ACME{i} INV",) for i in range(40)], [(f"ORDER-{i} ACME{i} PAID",) for i in range(40)], {M: 40}),
]


@pytest.mark.parametrize("a, b, wanted", CASES)
def test_cases(spark, a, b, wanted):
    names = [" ".join(f"k{i}" for i in range(len(side[0]))) for side in (a, b)]
    spec = request(names[0], names[1], flexible=True)
    found = outcome(table(spark, names[0], a), table(spark, names[1], b), spec)
    counts = {t: sum(x == t for x, _ in found) for t, _ in found}
    assert counts == wanted, found


def test_off_and_preference(spark):
    one = lambda rows: table(spark, "k v", rows)
    a, b = one([("INV-**", "p")]), one([("INV-001", "q")])
    assert [t for t, _ in outcome(a, b, request("k"))] == [R, L]
    a, b = one([("INV-**", "1"), ("INV-2026-**", "2")]), one([("INV-2026-001", "x")])
    assert outcome(a, b, request("k", flexible=True)) == [(M, ("INV-2026-**",)), (R, ("INV-**",))]
    a, b = one([("**A", "1"), ("A**", "2")]), one([("AA", "1"), ("AAA", "2")])
    assert [t for t, _ in outcome(a, b, request("k", values_a="v", flexible=True))] == [M, M]
    a, b = one([("INV-**", "p")]), one([("INV-1", "p"), ("INV-2026-000000", "q")])
    assert [t for t, _ in outcome(a, b, request("k", values_a="v", flexible=True))] == [M, L]


def test_limits(spark):
    a = table(spark, "k", [(f"**{i}",) for i in range(6)])
    b = table(spark, "k", [(f"A**{i % 2}",) for i in range(6)])
    with pytest.raises(ReconError, match="21"):
        outcome(a, table(spark, "k", [(f"x{i}",) for i in range(6)]), request("k", flexible=True, max_comparisons=20))
    with pytest.raises(ReconError):
        outcome(a, b, request("k", flexible=True, max_candidates=1))


def test_dense_components(spark):
    a = table(spark, "x y", [("**", f"A{i:02d}") for i in range(8)])
    b = table(spark, "x y z", [(f"B{i:02d}", "MIDDLE", "**") for i in range(8)])
    found = outcome(a, b, request("x y", "x y z", flexible=True))
    assert [t for t, _ in found] == [M] * 8


def best_choice(edges):
    """Most edges one to one, then the lexicographically first by position."""
    for size in range(len(edges), -1, -1):
        for chosen in itertools.combinations(range(len(edges)), size):
            if len({edges[e][0] for e in chosen}) == len({edges[e][1] for e in chosen}) == size:
                return list(chosen)


def test_assignment_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        edges = sorted({(rng.randrange(4), rng.randrange(4)) for _ in range(rng.randrange(1, 9))}, key=lambda e: rng.random())
        left = {x: i for i, x in enumerate(dict.fromkeys(e[0] for e in edges))}
        right = {y: i for i, y in enumerate(dict.fromkeys(e[1] for e in edges))}
        found = assign(np.array([left[e[0]] for e in edges]), np.array([right[e[1]] for e in edges]))
        assert list(found) == best_choice(edges), edges


def test_patterns_against_expansion():
    rng = random.Random(7)
    texts = ["".join(t) for n in range(5) for t in itertools.product("ab", repeat=n)]

    def fits(pattern, text):
        if not pattern:
            return not text
        if pattern.startswith("**"):
            return fits(pattern[2:], text) or bool(text) and fits(pattern, text[1:])
        return text[:1] == pattern[0] and fits(pattern[1:], text[1:])

    for _ in range(300):
        p, q = ("".join(rng.choice(["a", "b", "**"]) for _ in range(rng.randrange(1, 4))) for _ in range(2))
        if "**" in p + q:
            both = p == q or any(fits(p, t) and fits(q, t) for t in texts)
            assert (pattern_kind([p], [q]) == "component_wildcard") == both, (p, q)


def test_blocking_misses_no_pair(spark):
    rng = random.Random(11)
    words = ["north", "harbor", "Remote", "EAST", "7", "12", "RF7", "x", "ABCD12"]
    keys = [[(" ".join(rng.choice(words) for _ in range(3)), rng.choice(["7", "north x", "12 east"])) for _ in range(60)] for _ in range(2)]
    spec = request("k l")
    sides = [groups(prepared(table(spark, "k l", rows), ("k", "l"), (), spec, ("_n",)), s) for s, rows in zip("ab", keys, strict=True)]
    found = {(tuple(r["nkey_a"]), tuple(r["nkey_b"])): r["kind"] for r in token_candidates(*sides).collect()}
    from concordat.functions.tokens import component_tokens, shared_tokens
    from pyspark.sql import functions as F

    a, b = (s.select(F.col("nkey").alias(f"k{n}"), F.transform("nkey", component_tokens).alias(f"t{n}")) for n, s in zip("ab", sides, strict=True))
    every = a.join(b, F.col("ka") != F.col("kb")).select("ka", "kb", shared_tokens(F.col("ka"), F.col("kb"), F.col("ta"), F.col("tb")).alias("kind")).where("kind is not null")
    assert found == {(tuple(r["ka"]), tuple(r["kb"])): r["kind"] for r in every.collect()} and found
