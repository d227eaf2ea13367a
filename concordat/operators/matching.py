"""One-to-one assignment of candidate pairs: as many as can be, and of such choices the most preferred, pair after pair.

Pairs whose two keys have no other are chosen at once.  The rest falls into connected components, each of which has a choice of its own.  Those of at most
``most`` pairs are solved in tasks (``assign``), many to a task.  Larger ones stay distributed:

1. Greedy choice in rounds: pairs that both their keys prefer to all others are chosen, then the ``most`` first pairs in turn, and their keys leave.  The result is what choosing pair after pair gives,
   the most preferred choice of all.  If it matches every key of one side of the component, it has as many pairs as can be, so it is the answer.
2. Elsewhere the choice is made as large as can be: breadth-first forests of alternating paths grow from all unmatched keys, a key in one tree
   alone, and the first path of each tree to a free key is turned over, until there is none.
3. What the last forests reach tells which pairs no largest choice holds (keys reached from unmatched keys of A, those reached from unmatched keys of B, and the
   others only match among themselves); without those pairs a component falls apart, and its parts go through these steps again.

A part that steps 1 and 3 leave whole is solved in one task; ``over`` says which to do with one that has more than ``most`` pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.operators.graph import components, cut
from concordat.spec import ReconError

#: Pairs of a component that one task takes, and that a task takes on average when it takes several.
MOST, EDGES = 200_000, 20_000


def preference() -> list[Column]:
    return [F.desc("rank"), F.desc("literals"), F.asc("patterns"), F.asc("first_a"), F.asc("first_b"), F.asc("nkey_a"), F.asc("nkey_b")]


def assign(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of edges in order of preference, those chosen: as many as can be one to one, and of such choices the most preferred.

    left and right number the ends of each edge from 0.
    """
    ahead: list[list[int]] = [[] for _ in range(int(left.max()) + 1)]
    behind: list[list[int]] = [[] for _ in range(int(right.max()) + 1)]
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        ahead[x].append(y)
        behind[y].append(x)
    to, back = [-1] * len(ahead), [-1] * len(behind)
    done_l, done_r = [False] * len(ahead), [False] * len(behind)

    def augment(start: int, edges: list[list[int]], mate: list[int], other: list[int], shut: list[bool]) -> bool:
        """Matches start, which is free, along an alternating path to a free end on the other side."""
        came: dict[int, int] = {}
        queue = [start]
        for x in queue:
            for y in edges[x]:
                if shut[y] or y in came:
                    continue
                came[y] = x
                if other[y] < 0:
                    while True:
                        x = came[y]
                        mate[x], other[y], y = y, x, mate[x]
                        if x == start:
                            return True
                queue.append(other[y])
        return False

    for x in range(len(ahead)):
        augment(x, ahead, to, back, done_r)
    chosen = []
    for e, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        if done_l[x] or done_r[y]:
            continue
        mate_y, mate_x = to[x], back[y]
        keep = mate_y == y
        if not keep:
            # forcing the edge frees its ends' mates; a full matching remains if one of two freed mates finds another
            for side, one, two in ((to, x, mate_x), (back, y, mate_y)):
                side[one] = -1
                if two >= 0:
                    side[two] = -1
            done_l[x] = done_r[y] = True
            keep = mate_x < 0 or mate_y < 0 or augment(mate_x, ahead, to, back, done_r) or augment(mate_y, behind, back, to, done_l)
        if keep:
            to[x], back[y] = y, x
            done_l[x] = done_r[y] = True
            chosen.append(e)
        else:  # no path was found, so that only the freed ends have changed
            to[x], back[y] = mate_y, mate_x
            if mate_x >= 0:
                to[mate_x] = y
            if mate_y >= 0:
                back[mate_y] = x
            done_l[x] = done_r[y] = False
    return np.array(chosen, np.int64)


def _side_of(pairs: DataFrame, s: str) -> Column:
    return F.struct(F.lit(s).alias("s"), F.col(f"nkey_{s}").alias("k"))


def with_components(pairs: DataFrame) -> DataFrame:
    """Adds ``component``, the least key that pairs reach."""
    ends = pairs.select("*", _side_of(pairs, "a").alias("_a"), _side_of(pairs, "b").alias("_b"))
    found = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    return ends.join(found, F.col("_a") == F.col("node")).select(*pairs.columns, "component")


def in_tasks(pairs: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The choice of each component, in tasks; small components share one."""
    numbered = pairs.select(
        *columns,
        F.xxhash64("component").alias("component"),
        F.row_number().over(W.partitionBy("component").orderBy(*preference())).alias("turn"),
        F.xxhash64("nkey_a").alias("x"),
        F.xxhash64("nkey_b").alias("y"),
    )

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["component", "turn"])
        component, x, y = (rows[c].to_numpy() for c in ("component", "x", "y"))
        edges = np.flatnonzero(np.r_[True, component[1:] != component[:-1], True])
        kept = [lo + assign(pd.factorize(x[lo:hi])[0], pd.factorize(y[lo:hi])[0]) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return rows[["component", "turn"]].iloc[np.concatenate(kept)]

    batch = F.pmod("component", F.lit(1 + n // EDGES)).alias("batch")
    chosen = numbered.select("component", "turn", "x", "y").groupBy(batch).applyInPandas(choose, "component long, turn int")
    return numbered.join(chosen, ["component", "turn"], "left_semi").select(columns)


def _first_come(rows: pd.DataFrame) -> pd.DataFrame:
    """Of pairs in turn, those of which neither key was in a pair chosen before."""
    rows, used, keep = rows.sort_values("turn"), set(), []
    for x, y, turn in zip(rows["x"].tolist(), rows["y"].tolist(), rows["turn"].tolist(), strict=True):
        if ("a", x) not in used and ("b", y) not in used:
            used.update((("a", x), ("b", y)))
            keep.append(turn)
    return pd.DataFrame({"turn": np.array(keep, np.int64)})


def greedy(pairs: DataFrame, most: int = MOST) -> DataFrame:
    """(nkey_a, nkey_b): what choosing the most preferred pair, again and again, gives; pairs have an order column ``pref``.

    A round chooses all pairs that both keys prefer, wherever they are, and then goes through the ``most`` first of those left in turn, in
    one task, so that a chain of preferences does not take a round for each pair.
    """
    left, chosen = pairs.select("nkey_a", "nkey_b", "pref"), []

    def without(left: DataFrame, now: DataFrame) -> DataFrame:
        chosen.append(now)
        return cut(left.join(now.select("nkey_a"), "nkey_a", "left_anti").join(now.select("nkey_b"), "nkey_b", "left_anti"))

    while left.limit(1).count():
        best = [left.groupBy(f"nkey_{s}").agg(F.min("pref").alias(f"best_{s}")) for s in "ab"]
        both = left.join(best[0], "nkey_a").join(best[1], "nkey_b").where("pref = best_a and pref = best_b")
        left = without(left, cut(both.select("nkey_a", "nkey_b")))
        first = left.orderBy("pref").limit(most).withColumn("turn", F.row_number().over(W.orderBy("pref")))  # most rows
        first = cut(first.select("nkey_a", "nkey_b", "turn", F.xxhash64("nkey_a").alias("x"), F.xxhash64("nkey_b").alias("y")))
        turns = first.groupBy(F.lit(0).alias("one")).applyInPandas(_first_come, "turn long")
        left = without(left, cut(first.join(turns, "turn", "left_semi").select("nkey_a", "nkey_b")))
    out = pairs.select("nkey_a", "nkey_b").limit(0)
    for part in chosen:
        out = out.union(part)
    return cut(out)


def _forest(pairs: DataFrame, matched: DataFrame, s: str, stop: bool) -> tuple[DataFrame, DataFrame, int]:
    """(trees, free ends, layers): alternating paths from all unmatched keys of side s.

    trees: (x, y, root, layer), x of side s and y the key of the other side that it is the parent of; each y once.  stop: end at the first layer that meets free keys.
    """
    t = "b" if s == "a" else "a"
    edges = pairs.select(F.col(f"nkey_{s}").alias("x"), F.col(f"nkey_{t}").alias("y"))
    mates = matched.select(F.col(f"nkey_{s}").alias("mate"), F.col(f"nkey_{t}").alias("y"))
    front = cut(edges.select("x").distinct().join(mates.select(F.col("mate").alias("x")), "x", "left_anti").select("x", F.col("x").alias("root")))
    trees, layer = None, 0
    while front.limit(1).count():
        step = front.join(edges, "x")
        if trees is not None:
            step = step.join(trees.select("y"), "y", "left_anti")
        step = cut(step.groupBy("y").agg(F.min(F.struct("x", "root")).alias("m")).select("m.x", "y", "m.root", F.lit(layer).alias("layer")))
        trees = step if trees is None else cut(trees.union(step))
        free = step.join(mates, "y", "left_anti")
        if stop and free.limit(1).count():
            return trees, cut(free.groupBy("root").agg(F.min("y").alias("y")).select("y", "root")), layer
        front = cut(step.join(mates, "y").select(F.col("mate").alias("x"), "root"))
        layer += 1
    return trees if trees is not None else cut(edges.select("x", "y", F.col("x").alias("root"), F.lit(0).alias("layer")).limit(0)), None, layer


def largest(pairs: DataFrame, matched: DataFrame) -> DataFrame:
    """matched, made as large as can be along alternating paths."""
    matched = cut(matched.select("nkey_a", "nkey_b"))
    while True:
        trees, ends, layer = _forest(pairs, matched, "a", stop=True)
        if ends is None:
            return matched
        # back from the free keys: each takes its parent, which gives up its mate, the parent's own way back
        new, gone, at = None, None, ends.select("y", "root")
        for _ in range(layer + 1):
            step = cut(at.join(trees.drop("root"), "y").select(F.col("x").alias("nkey_a"), F.col("y").alias("nkey_b"), "root"))
            new = step.select("nkey_a", "nkey_b") if new is None else new.union(step.select("nkey_a", "nkey_b"))
            old = cut(step.select("nkey_a", "root").join(matched, "nkey_a").select("nkey_a", "nkey_b", "root"))
            gone = old.select("nkey_a", "nkey_b") if gone is None else gone.union(old.select("nkey_a", "nkey_b"))
            at = old.select(F.col("nkey_b").alias("y"), "root")
        matched = cut(matched.join(gone, ["nkey_a", "nkey_b"], "left_anti").union(new))


def possible(pairs: DataFrame, matched: DataFrame) -> DataFrame:
    """pairs without those that no largest choice holds, as far as unmatched keys tell; matched is a largest choice."""
    out = pairs
    for s, t in ("ab", "ba"):
        trees, _, _ = _forest(pairs, matched, s, stop=False)
        # a key of t that unmatched keys of s reach is matched to keys that they reach too
        reached_t = trees.select(F.col("y").alias(f"nkey_{t}")).distinct()
        mates = matched.join(reached_t, f"nkey_{t}", "left_semi").select(f"nkey_{s}")
        free = pairs.select(f"nkey_{s}").distinct().join(matched.select(f"nkey_{s}"), f"nkey_{s}", "left_anti")
        reached_s = mates.union(free)
        inside = out.join(reached_t, f"nkey_{t}", "left_semi").join(reached_s, f"nkey_{s}", "left_semi")
        outside = out.join(reached_t, f"nkey_{t}", "left_anti").join(reached_s, f"nkey_{s}", "left_anti")
        out = cut(inside.union(outside))
    return out


def assigned(pairs: DataFrame, most: int = MOST, over: str = "solve") -> DataFrame:
    """The candidates chosen.  over: solve, or fail, for a part of more than ``most`` pairs that no distributed step settles."""
    columns = pairs.columns
    pairs = cut(pairs)
    several = [pairs.groupBy(f"nkey_{s}").count().where("count > 1").select(f"nkey_{s}") for s in "ab"]
    alone = pairs.join(several[0], "nkey_a", "left_anti").join(several[1], "nkey_b", "left_anti").select(columns)
    rest = cut(pairs.join(alone.select("nkey_a"), "nkey_a", "left_anti").select(columns))
    out = alone
    while rest.limit(1).count():
        rest = cut(with_components(rest))
        sizes = rest.groupBy("component").agg(F.count("*").alias("n"), F.countDistinct("nkey_a").alias("n_a"), F.countDistinct("nkey_b").alias("n_b"))
        sizes = cut(sizes)
        large = sizes.where(F.col("n") > most)
        small = rest.join(large, "component", "left_anti")
        out = out.union(in_tasks(cut(small), columns, rest.count()))
        rest = cut(rest.join(large.select("component"), "component", "left_semi"))
        if not rest.limit(1).count():
            break
        order = F.struct((-F.col("rank")).alias("r"), (-F.col("literals")).alias("l"), "patterns", "first_a", "first_b", "nkey_a", "nkey_b")
        ordered = cut(rest.withColumn("pref", order))
        chosen = greedy(ordered, most)
        held = cut(rest.join(chosen, ["nkey_a", "nkey_b"]))
        done = held.groupBy("component").agg(F.count("*").alias("m")).join(sizes, "component").where("m = n_a or m = n_b").select("component")
        done = cut(done)
        out = out.union(held.join(done, "component", "left_semi").select(columns))
        rest = cut(rest.join(done, "component", "left_anti"))
        if not rest.limit(1).count():
            break
        before = rest.count()
        matched = largest(rest, held.join(done, "component", "left_anti"))
        # where the greedy choice is as large as can be, it is the answer
        as_many = held.groupBy("component").agg(F.count("*").alias("m")).join(
            rest.select("nkey_a", "component").distinct().join(matched, "nkey_a").groupBy("component").agg(F.count("*").alias("k")), "component"
        )
        done = cut(as_many.where("m = k").select("component"))
        out = out.union(held.join(done, "component", "left_semi").select(columns))
        rest = cut(rest.join(done, "component", "left_anti").select(columns))
        matched = matched.join(rest.select("nkey_a").distinct(), "nkey_a", "left_semi")
        rest = possible(rest, matched).select(columns)
        if rest.count() == before:
            if over == "fail":
                raise ReconError(f"a part of more than {most} candidates cannot be split")
            out = out.union(in_tasks(cut(with_components(rest)), columns, rest.count()))
            break
    return out
