"""Distributed assignment and the blocking of flexible keys against plain versions."""

import itertools
import random
import re

import pytest
from helpers import request, table
from pyspark.sql import functions as F

from concordat.functions.tokens import component_tokens, pattern_kind, shared_tokens
from concordat.operators import flexible, graph, matching
from concordat.operators.compare import groups, prepared, reconcile

PAIRS = "nkey_a array<string>, nkey_b array<string>, rank int, literals int, patterns int, first_a struct<n:int>, first_b struct<n:int>"


def candidates(spark, edges):
    """Pairs in order of preference, as a shuffled table."""
    rows = [([f"x{x}"], [f"y{y}"], 3, -k, 0, (0,), (0,)) for k, (x, y) in enumerate(edges)]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), PAIRS)


def plain_choice(edges):
    left, right = ({v: i for i, v in enumerate(dict.fromkeys(e[n] for e in edges))} for n in (0, 1))
    import numpy as np

    chosen = matching.assign(np.array([left[e[0]] for e in edges]), np.array([right[e[1]] for e in edges]))
    return sorted(edges[k] for k in chosen)


def found(df):
    return sorted((int(r["nkey_a"][0][1:]), int(r["nkey_b"][0][1:])) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_distributed_steps_against_one_task(spark, seed):
    """most=2 sends nearly every component through the distributed steps; assign itself is held against brute force elsewhere."""
    rng = random.Random(seed)
    edges = []
    for block in range(4):  # separate graphs of several shapes
        a, b = rng.randrange(2, 7), rng.randrange(2, 7)
        every = [(10 * block + x, 10 * block + y) for x in range(a) for y in range(b)]
        edges += rng.sample(every, rng.randrange(2, len(every) + 1))
    rng.shuffle(edges)
    assert found(matching.assigned(candidates(spark, edges), most=2)) == plain_choice(edges)


def test_larger_choice_and_possible_pairs(spark):
    # a path whose greedy choice is one pair short, and a pair that no largest choice holds
    edges = [(1, 0), (0, 0), (1, 1), (2, 1), (2, 2), (0, 9), (5, 9)]
    pairs = candidates(spark, edges)
    rng = random.Random(3)
    graphs = [edges] + [rng.sample([(x, y) for x in range(5) for y in range(5)], rng.randrange(3, 12)) for _ in range(3)]
    for graph in graphs:
        pairs = candidates(spark, graph)
        size = next(n for n in range(5, -1, -1) if any(len({e[0] for e in c}) == len({e[1] for e in c}) == n for c in itertools.combinations(graph, n)))
        best = [set(c) for c in itertools.combinations(graph, size) if len({e[0] for e in c}) == len({e[1] for e in c}) == size]
        matched = matching.largest(pairs, pairs.limit(0))
        assert len(set(found(matched))) == size and set(found(matched)) <= set(graph)
        left = set(found(matching.possible(pairs, matched)))
        assert set().union(*best) <= left
        gone = set(graph) - left
        assert not any(gone & c for c in best)


def test_dense_component_over_the_size_of_a_task(spark, monkeypatch):
    """3,600 pairs, all of one component, whose preferences form a chain: no task may take them, and the greedy rounds settle them."""
    monkeypatch.setattr(matching, "in_tasks", lambda pairs, columns, n: pairs.select(columns) if pairs.limit(1).count() == 0 else pytest.fail("a task took it"))
    n = 60
    x, y = (spark.range(n).select(F.array(F.concat(F.lit(s), F.col("id").cast("string"))).alias(f"nkey_{t}"), F.struct(F.col("id").cast("int").alias("n")).alias(f"first_{t}")) for s, t in (("x", "a"), ("y", "b")))
    pairs = x.join(y).select("nkey_a", "nkey_b", F.lit(3).alias("rank"), F.when(F.abs(F.col("first_a.n") - F.col("first_b.n")) <= 1, 9).otherwise(1).alias("literals"), F.lit(0).alias("patterns"), "first_a", "first_b")
    got = found(matching.assigned(pairs, most=500))
    assert got == [(k, k) for k in range(n)]


def sides(spark, names, rows_a, rows_b):
    spec = request(names, names, flexible=True)
    return [groups(prepared(table(spark, names, rows), tuple(names.split()), (), spec, ("_n",)), s) for s, rows in (("a", rows_a), ("b", rows_b))]


def test_every_classified_pair_of_one_component_is_met_or_weak_for_good(spark):
    """Tokens: pairs by more than a word are all met; of the others those survive that have no other candidate."""
    rng = random.Random(5)
    words = ["north", "harbor", "remote", "east", "terminal", "depot", "7", "12", "rf7", "abcd12", "x"]
    for few in (3, 11):
        pool = rng.sample(words, few) + [f"word{c}" for c in "abcdefghij" for _ in range(1)]
        rows = [[(" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 4))),) for _ in range(60)] for _ in range(2)]
        a, b = sides(spark, "k", *rows)
        spec = request("k", "k", flexible=True)
        key = lambda k, s: k.select(F.col("nkey").alias(f"k{s}"), F.transform("nkey", component_tokens).alias(f"t{s}"))
        every = key(a, "a").join(key(b, "b"))
        kind = F.when(F.col("ka") == F.col("kb"), "exact").otherwise(shared_tokens(F.col("ka"), F.col("kb"), F.col("ta"), F.col("tb")))
        all_pairs = [(r["ka"][0], r["kb"][0], r["kind"]) for r in every.select("ka", "kb", kind.alias("kind")).where("kind is not null").collect()]
        degree = [{}, {}]
        for x, y, _ in all_pairs:
            degree[0][x] = degree[0].get(x, 0) + 1
            degree[1][y] = degree[1].get(y, 0) + 1
        wanted = sorted((x, y) for x, y, k in all_pairs if k != "shared_text" or degree[0][x] == degree[1][y] == 1)
        got = sorted((r["nkey_a"][0], r["nkey_b"][0]) for r in flexible.candidates(a, b, spec).collect())
        assert got == wanted


@pytest.mark.parametrize("names", ["k", "k l"])
def test_every_pattern_pair_is_met(spark, names):
    rng = random.Random(len(names))
    letters = ["a", "b", "ab", "**", "**", r"\E", ".", "*", "x1"]
    cell = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 5)))
    rows = [list(dict.fromkeys(tuple(cell() for _ in names.split()) for _ in range(45))) for _ in range(2)]
    a, b = sides(spark, names, *rows)
    n = len(names.split())
    got = {(tuple(r["nkey_a"]), tuple(r["nkey_b"])): r["kind"] for r in flexible.pattern_candidates(a, b, (n, n)).collect()}
    wanted = {(x, y): k for x in rows[0] for y in rows[1] if x != y and "**" in "".join(c + " " for c in x + y) and (k := pattern_kind(x, y))}
    assert got == wanted and len(got) > 50


def test_a_word_in_every_key_makes_no_block(spark):
    """All keys hold one word: nothing but the pairs that count is joined."""
    spelt = ["".join("abcdefghij"[int(c)] for c in f"{k:03d}") for k in range(300)]
    a, b = sides(spark, "k", [(f"order left{s}",) for s in spelt], [(f"order right{s}",) for s in spelt])
    pairs, several = flexible.lone_word_candidates(a, b)
    assert pairs.count() == 0 and [s.count() for s in several] == [300, 300]
    assert flexible.token_candidates(a, b, (1, 1)).count() == 0
    assert flexible.candidates(a, b, request("k", "k", flexible=True)).count() == 0


def from_range(spark, n, ends):
    """Keys by rows that are exploded, of which Spark expects a few bytes."""
    each = spark.range(n).select("id", F.posexplode(F.array(*map(F.lit, ends))).alias("j", "end"))
    return each.select((4 * F.col("id") + F.col("j")).alias("_n"), F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), "end").alias("k"))


def test_keys_are_not_broadcast_by_their_estimated_size(spark, monkeypatch):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return graph.cut(df)

    monkeypatch.setattr(flexible, "cut", cut)
    monkeypatch.setattr(flexible, "BROADCAST_ROWS", 0, raising=False)
    results = reconcile(from_range(spark, 20, ("-**", "-A**", "-AB**")), from_range(spark, 20, ("-ABC", "-AX", "-Y")), request("k", flexible=True)).results
    plans.append(results._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)
    assert results.groupBy("result_type").count().collect() == [("match", 60)]


def test_keys_with_heads_do_not_meet_on_tails(spark):
    """A tail that all keys share makes no pair of keys that both have heads, also none that a condition drops again."""
    a, b = sides(spark, "k", [(f"H{k}-**-END",) for k in range(5)] + [("**-END",)], [(f"H{k}-X**END",) for k in range(5)])
    met = flexible.patterns_with_patterns(flexible.numbered(a), flexible.numbered(b))
    assert not re.search(r"Join .*head_a.* OR .*head_b", met._jdf.queryExecution().optimizedPlan().toString())
    assert sorted((r["nkey_a"][0], r["nkey_b"][0]) for r in met.collect()) == sorted([(f"H{k}-**-END", f"H{k}-X**END") for k in range(5)] + [("**-END", f"H{k}-X**END") for k in range(5)])


@pytest.mark.parametrize("heavy, rows", [(2, 0), (3, 0), (10_000, 200_000)])
def test_lone_words_by_any_join(spark, monkeypatch, heavy, rows):
    """Words told to all tasks, or joined, decide alike, and no join by words holds those of very many keys."""
    monkeypatch.setattr(flexible, "HEAVY", heavy)
    monkeypatch.setattr(flexible, "BROADCAST_ROWS", rows)
    a, b = sides(spark, "k", [("zero left",), ("oneone left",), ("twotwo left",), ("three four",), ("fives left",), ("sixsix rest",), ("seven",)], [
        ("zero right",), ("oneone right",), ("oneone other",), ("twotwo rest",), ("three four right",), ("fives right",), ("sixsix right",), ("seven",), ("eight left right",)])
    got = sorted((r["nkey_a"][0], r["nkey_b"][0], r["rank"]) for r in flexible.candidates(a, b, request("k", flexible=True)).collect())
    # "left" is one key's word in B and four keys' in A, so that none of these is alone; "rest" joins twotwo and sixsix
    assert got == [("seven", "seven", 4), ("three four", "three four right", 1)]
    a, b = sides(spark, "k", [("zero left",), ("oneone left",), ("twotwo left",)], [("zero right",), ("oneone right",), ("oneone other",), ("twotwo right",)])
    got = sorted((r["nkey_a"][0], r["nkey_b"][0], r["rank"]) for r in flexible.candidates(a, b, request("k", flexible=True)).collect())
    assert got == [("twotwo left", "twotwo right", 0), ("zero left", "zero right", 0)]


def test_tokens_shuffle_hashes_and_numbers(spark):
    """Blocks of tokens are by numbers and hold no text."""
    a, b = sides(spark, "k", [(f"ORDER-{k} ACME{k} INV",) for k in range(30)], [(f"ORDER-{k} ACME{k} PAID",) for k in range(30)])
    met = flexible.token_candidates(a, b, (1, 1))
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, \(term#\d+L = term#\d+L\)", plan)  # numbers, not texts
    assert sorted((r["nkey_a"][0], r["nkey_b"][0], r["kind"]) for r in met.collect()) == sorted((f"ORDER-{k} ACME{k} INV", f"ORDER-{k} ACME{k} PAID", "shared_anchored") for k in range(30))


def test_pairs_of_keys_left_over_on_both_sides_without_broadcast(spark, monkeypatch):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return graph.cut(df)

    monkeypatch.setattr(flexible, "cut", cut)
    monkeypatch.setattr(flexible, "BROADCAST_ROWS", 0, raising=False)
    a, b = from_range(spark, 6, ("-**", "-A**")), from_range(spark, 6, ("-ABC", "-AX", "-Y", "-ZZ")).where("_n % 3 = 0 or _n > 20")
    found = reconcile(a, b, request("k", flexible=True)).results
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    assert not any("BroadcastHashJoin" in p for p in plans)
    rows = sorted((r["result_type"], r["key"][0]) for r in found.collect())
    assert [r for r in rows if r[0] != "match"] == [("missing_left", "000005-ZZ"), ("missing_right", "000001-A**"), ("missing_right", "000002-**"), ("missing_right", "000004-A**")]
    assert len(rows) == 13
