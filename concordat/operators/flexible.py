"""Flexible key matching: candidates by blocking, weak ones pruned, one-to-one assignment.

No key meets every other.  Equal keys meet by an equi-join.  Keys without patterns meet on two terms at once, so that a word that most keys hold
makes no large block: of one component a number with a word, or two words; of several components a term each of two of them.  Pairs that
share one word only count where neither key has another candidate, so those words alone are met that a single key of one side holds.
A key with ``**`` meets keys without on the rarest of what must stand in them: its head, its tail, or a few letters between
its patterns; regular expressions decide these pairs in the JVM.  Two keys with ``**`` meet on their heads or tails.

Keys are numbered in the order that ties follow, and from then on pairs are two numbers: what is written between steps holds no text of keys but the list of keys itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.functions.tokens import (
    ANY, RANKS, component_tokens, components_fit, has_numbers, has_pattern, literal_pieces, may_fit, pattern_match, shared_tokens,
)
from concordat.operators.graph import BROADCAST_ROWS, cut
from concordat.operators.matching import assign, assigned, preference  # noqa: F401
from concordat.spec import ReconError, ReconSpec

#: Parts into which keys are dealt that patterns without any letter meet.
SALTS = 32
#: Most lengths of heads, and of tails, that keys with patterns meet on, and most letters of what they meet on in between.
LENGTHS, GRAM = 32, 3
#: Keys of a side from which on a word that they hold is not joined by shuffle.
HEAVY = 10_000


def _terms(component: Column, tokens: Column, side: str) -> Column:
    """What a component is blocked on.  Words are marked by which of the two sides has digits."""
    words = lambda mark: F.transform(tokens["alpha"], lambda t: F.concat(F.lit(mark), t))
    numbers = F.concat(
        F.transform(tokens["numbers"], lambda t: F.concat(F.lit("n:"), t)), F.transform(tokens["identifiers"], lambda t: F.concat(F.lit("i:"), t))
    )
    with_digits = F.concat(numbers, words("DN:" if side == "a" else "ND:"))
    without = F.concat(words("NN:"), words("ND:" if side == "a" else "DN:"))
    return F.concat(F.array(F.concat(F.lit("=:"), component)), F.when(has_numbers(tokens), with_digits).otherwise(without))


def _pairs_of(words: Column) -> Column:
    """Every two of an array's entries, the lesser first."""
    return F.flatten(F.transform(words, lambda x: F.transform(F.filter(words, lambda y: x < y), lambda y: F.concat(F.lit("w:"), x, F.lit("\x1f"), y))))


def _products(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.concat(x, F.lit("\x1f"), y))))


def kept(df: DataFrame) -> DataFrame:
    """df as ``cut`` writes it, not to be broadcast unasked.

    Spark takes its size from the compressed size of the files that it came from and is blind to exploded rows, so that it would send millions of keys through the driver.
    """
    return cut(df).hint("merge")


def numbered(side: DataFrame) -> DataFrame:
    """(id, nkey) of a side's groups; id follows their first rows, then the keys."""
    if "id" in side.columns:
        return side
    return kept(side.select("nkey", F.col(next(c for c in side.columns if c.startswith("first_"))).getField("rid").alias("rid")).orderBy("rid", "nkey").select(F.monotonically_increasing_id().alias("id"), "nkey"))


def _nothing(side: DataFrame, *columns: str) -> DataFrame:
    kinds = {"kind": "string", "id": "bigint", "id_a": "bigint", "id_b": "bigint"}
    return side.sparkSession.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'array<string>')}" for c in columns))


def _named(side: DataFrame, s: str) -> DataFrame:
    return side.select(F.col("id").alias(f"id_{s}"), F.col("nkey").alias(f"nkey_{s}"))


def _plain(a: DataFrame, b: DataFrame) -> list[DataFrame]:
    return [k.where(~has_pattern(F.col("nkey"))).select("id", "nkey", F.transform("nkey", component_tokens).alias("t")) for k in (numbered(a), numbered(b))]


def token_candidates(a: DataFrame, b: DataFrame, parts: tuple[int, int] | None = None) -> DataFrame:
    """(nkey_a, nkey_b, kind, id_a, id_b) of unequal keys without patterns that share tokens; of keys of one component those alone that share more than a word.

    parts: how many components the keys of each side have; found out if not given.
    """
    a, b = numbered(a), numbered(b)
    plain = _plain(a, b)
    if parts is None:
        parts = tuple(max((k.select(F.size("nkey")).first() or [0])[0], 0) for k in plain)
    if parts[0] != parts[1] or not parts[0] or not all(k.limit(1).count() for k in plain):
        return _nothing(a, "nkey_a", "nkey_b", "kind", "id_a", "id_b")
    if parts[0] == 1:
        t = F.get("t", 0)
        mark = lambda m, words: F.transform(words, lambda w: F.concat(F.lit(m), w))
        # a shared identifier that is a word too is enough; other numbers need a word beside them, which then is no identifier
        numbers = F.concat(mark("n:", t["numbers"]), mark("i:", F.array_except(t["identifiers"], t["alpha"])))
        both = mark("i:", F.array_intersect(t["identifiers"], t["alpha"]))
        terms = [F.concat(both, _products(numbers, F.array_except(t["alpha"], t["identifiers"])), F.when(has_numbers(t), F.array().cast("array<string>")).otherwise(_pairs_of(t["alpha"])))] * 2
    else:
        each = F.explode(F.transform(F.sequence(F.lit(0), F.size("nkey") - 1), lambda i: F.struct(i.alias("i"), F.get("nkey", i).alias("c"))))
        sizes = plain[0].select(each.alias("x")).groupBy("x.i").agg(F.approx_count_distinct("x.c").alias("n")).orderBy(F.desc("n"), "i").limit(2).collect()
        # any two components are enough; those of most values make the smallest blocks
        one, two = (r["i"] for r in sizes) if len(sizes) == 2 else (0, 1)
        terms = [_products(*(_terms(F.get("nkey", i), F.get("t", i), s) for i in (one, two))) for s in "ab"]
    # a term's hash and a key's number are all that is shuffled; texts meet once for each pair of keys, and decide
    blocked = [k.select(F.col("id").alias(f"id_{s}"), F.explode(F.array_distinct(F.transform(x, lambda y: F.xxhash64(y)))).alias("term")) for s, k, x in zip("ab", plain, terms, strict=True)]
    met = blocked[0].join(blocked[1], "term").select("id_a", "id_b").repartition("id_a").distinct()
    for s, k in zip("ab", (a, b), strict=True):
        met = met.join(_named(k, s), f"id_{s}")
    met = met.where("nkey_a != nkey_b").select("*", *(F.transform(f"nkey_{s}", component_tokens).alias(f"t_{s}") for s in "ab"))
    kind = shared_tokens(F.col("nkey_a"), F.col("nkey_b"), F.col("t_a"), F.col("t_b"))
    return met.select("nkey_a", "nkey_b", F.explode(F.array_compact(F.array(kind))).alias("kind"), "id_a", "id_b")  # no condition, which would be made again for each use


def lone_word_candidates(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((id_a, id_b) by words that one key of each side holds, keys of each side of which a word has several partners or shares its only one).

    Words are counted with the least number of a key that holds them, which is that key where it is one, so that no word of many keys is gathered. A word of
    ``HEAVY`` keys is told to all tasks; other words' keys meet by join.
    """
    plain = _plain(a, b)
    if not all(k.limit(1).count() for k in plain):
        return _nothing(a, "id_a", "id_b"), [_nothing(a, f"id_{s}") for s in "ab"]
    words = [
        k.select(F.col("id").alias(f"id_{s}"), F.explode(F.when(~has_numbers(F.get("t", 0)), F.get("t", 0)["alpha"])).alias("word")) for s, k in zip("ab", plain, strict=True)
    ]
    none = F.lit(None).cast("bigint")
    held = words[0].select("word", "id_a", none.alias("id_b")).union(words[1].select("word", none, "id_b"))
    counts = held.groupBy("word").agg(*(F.count(f"id_{s}").alias(f"n_{s}") for s in "ab"), *(F.min(f"id_{s}").alias(f"id_{s}") for s in "ab"))
    shared, heavy = (F.col("n_a") > 0) & (F.col("n_b") > 0), F.greatest("n_a", "n_b") >= HEAVY
    word = F.when((F.col("n_a") > 1) | (F.col("n_b") > 1), F.col("word"))  # others are told by their two keys
    counts = kept(counts.where(shared | heavy).select(word.alias("word"), "n_a", "n_b", "id_a", "id_b"))
    light = {s: shared & (F.col(f"n_{s}") > 1) & (F.col(f"n_{s}") < HEAVY) for s in "ab"}
    many = counts.agg(*(F.count_if(x).alias(s) for s, x in light.items())).first()
    several = []
    for n, (s, other) in enumerate(("ab", "ba")):
        often = counts.where(F.col(f"n_{s}") >= HEAVY)  # no more words than a share of the keys
        found = counts.where(shared & (F.col(f"n_{s}") == 1) & (F.col(f"n_{other}") > 1)).select(f"id_{s}")
        found = found.union(words[n].join(F.broadcast(cut(often.where(shared).select("word"))), "word", "left_semi").select(f"id_{s}"))
        if many[s]:
            told = F.broadcast if many[s] <= BROADCAST_ROWS else lambda df: df
            by_word = cut(counts.where(light[s]).select("word"))
            rest = words[n] if many[s] <= BROADCAST_ROWS else words[n].join(F.broadcast(cut(often.select("word"))), "word", "left_anti")
            found = found.union(rest.join(told(by_word), "word", "left_semi").select(f"id_{s}"))
        several.append(found)
    return counts.where("n_a = 1 and n_b = 1").select("id_a", "id_b"), several


def _lengths(*patterns: DataFrame) -> dict[str, list[int]]:
    """The lengths that heads and tails of patterns have; of many, LENGTHS in even steps from the shortest on."""
    found: dict[str, set[int]] = {"head": set(), "tail": set()}
    for p in patterns:
        row = p.agg(*(F.collect_set(F.length(edge)).alias(edge) for edge in found)).first()  # no more numbers than a key has letters
        for edge, lengths in found.items():
            lengths.update(n for n in row[edge] if n)
    return {edge: sorted(n)[:: -(-len(n) // LENGTHS) or 1] for edge, n in found.items()}


def _sizes(text: Column, lengths: list[int]) -> Column:
    return F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(text))


def _block(mark: str, n: Column, text: Column) -> Column:
    return F.concat(F.lit(mark), n.cast("string"), F.lit(":"), text)


def _head(text: Column, n: Column) -> Column:
    return _block("h", n, F.substring(text, F.lit(1), n))


def _tail(text: Column, n: Column) -> Column:
    return _block("t", n, F.substring(text, F.length(text) - n + 1, n))


def _grams(text: Column, n: Column) -> Column:
    """All stretches of n letters."""
    cut_up = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: _block("g", n, F.substring(text, i, n)))
    return F.when(F.length(text) >= n, F.array_distinct(cut_up)).otherwise(F.array().cast("array<string>"))


def _parts(mark: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.concat(F.lit(mark), i.cast("string")))


def _own_part(mark: str, key: str) -> Column:
    return F.concat(F.lit(mark), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("string"))


def _patterns(keys: DataFrame) -> DataFrame:
    found = keys.where(has_pattern(F.col("nkey"))).select("id", "nkey", literal_pieces(F.col("nkey")).alias("pieces"))
    return found.select("id", "nkey", F.get("pieces", 0).alias("head"), F.get("pieces", F.size("pieces") - 1).alias("tail"), "pieces")


def patterns_with_texts(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(p, k), numbers of keys: each pattern of patterns with the keys without patterns of texts that hold the rarest of what its own must hold.

    What they meet on goes by its hash: pairs that only hashes make are few, and do not fit.
    """
    p = _patterns(patterns).withColumn("longest", F.array_max(F.transform("pieces", F.length)))
    edgeless = (F.col("head") == "") & (F.col("tail") == "")
    row = p.agg(F.count("*").alias("n"), F.collect_set(F.when(edgeless, F.least(F.lit(GRAM), "longest"))).alias("sizes")).first()
    if not row["n"]:
        return _nothing(patterns, "id", "nkey").select(F.col("id").alias("p"), F.col("id").alias("k"))
    lengths, sizes = _lengths(p), sorted(row["sizes"])  # grams are made only of the sizes that patterns without edges ask for; 0: without letters
    hashed = lambda blocks: F.array_distinct(F.transform(blocks, lambda x: F.xxhash64(x)))
    edges = F.array_compact(F.array(*(F.when(F.col(c) != "", made(F.col(c), F.array_max(_sizes(F.col(c), lengths[c])))) for c, made in (("head", _head), ("tail", _tail)))))
    between = F.flatten(F.transform("pieces", lambda x: _grams(x, F.least(F.lit(GRAM), "longest"))))
    blocks = F.when(F.size(edges) > 0, edges).when(F.col("longest") > 0, between).otherwise(_parts("s"))
    wanted = cut(p.select(F.col("id").alias("p"), F.explode(hashed(blocks)).alias("block"), (edgeless & (F.col("longest") == 0)).alias("all")))
    few = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda df: df.hint("merge")
    s = F.col("s")
    held = [F.transform(_sizes(s, lengths["head"]), lambda n: _head(s, n)), F.transform(_sizes(s, lengths["tail"]), lambda n: _tail(s, n))]
    held += [_grams(s, F.lit(n)) if n else F.array(_own_part("s", "nkey")) for n in sizes]
    k = texts.where(~has_pattern(F.col("nkey"))).select(F.col("id").alias("k"), "nkey", F.array_join("nkey", "").alias("s"))
    texts_at = kept(k.select("k", F.explode(hashed(F.concat(*held))).alias("block")).join(few(wanted.select("block").distinct()), "block", "left_semi"))
    counts = texts_at.groupBy("block").agg(F.count("*").alias("n"))
    counted = wanted.hint("merge").join(counts, "block", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.where("not all").groupBy("p").agg(F.min_by("block", F.struct("n", "block")).alias("block"))
    return rarest.union(wanted.where("all").select("p", "block")).join(texts_at, "block").select("p", "k")


def patterns_with_patterns(a: DataFrame, b: DataFrame) -> DataFrame:
    """(nkey_a, nkey_b, id_a, id_b): keys that both hold patterns, and whose heads and tails agree as far as both go, or of which one has none where the other has."""
    columns = ["nkey_a", "nkey_b", "id_a", "id_b"]
    left, right = (_patterns(k).drop("pieces").withColumnsRenamed({c: f"{c}_{s}" for c in ("id", "nkey", "head", "tail")}) for s, k in (("a", a), ("b", b)))
    if not (left.limit(1).count() and right.limit(1).count()):
        return _nothing(a, *columns)

    lengths = _lengths(*(k.select(F.col(f"head_{s}").alias("head"), F.col(f"tail_{s}").alias("tail")) for s, k in (("a", left), ("b", right))))

    def along(edge: str, made, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of which both have the edge, met at the longest size that both have."""
        sides = []
        for s, k in (("a", left), ("b", right)):
            text = F.col(f"{edge}_{s}")
            at = k.select("*", F.array_max(_sizes(text, lengths[edge])).alias(f"most_{s}"), F.explode(_sizes(text, lengths[edge])).alias(f"n_{s}"))
            sides.append(at.withColumn("block", made(text, F.col(f"n_{s}"))))
        return sides[0].join(sides[1], "block").where("n_a = most_a or n_b = most_b")

    heads = along("head", _head, left, right).select(columns)
    # keys that both have heads have met on those: a tail that they all share must not bring them together
    tails = along("tail", _tail, left.where("head_a = ''"), right).union(along("tail", _tail, left.where("head_a != ''"), right.where("head_b = ''"))).select(columns)

    def open_sides(k: DataFrame, s: str) -> DataFrame:
        no_head, no_tail, key = F.col(f"head_{s}") == "", F.col(f"tail_{s}") == "", f"nkey_{s}"
        every = lambda mark: _parts(mark)
        own = lambda mark: F.array(_own_part(mark, key))
        none = F.array().cast("array<string>")
        first = s == "a"
        blocks = [
            F.when(no_head & no_tail, every("n") if first else none) if first else own("n"),
            F.when(~(no_head & no_tail), own("m")) if first else F.when(no_head & no_tail, every("m")),
            F.when(~no_head & no_tail, every("ht")) if first else F.when(no_head & ~no_tail, own("ht")),
            F.when(no_head & ~no_tail, own("th")) if first else F.when(~no_head & no_tail, every("th")),
        ]
        return k.select(key, f"id_{s}", F.explode(F.concat(*(F.coalesce(x, none) for x in blocks))).alias("block"))

    rest = open_sides(left, "a").join(open_sides(right, "b"), "block").select(columns)
    return heads.union(tails).union(rest)


def pattern_candidates(a: DataFrame, b: DataFrame, parts: tuple[int, int] = (2, 2)) -> DataFrame:
    """(nkey_a, nkey_b, kind, id_a, id_b) of unequal keys of which one or both hold a pattern.

    Python tells pairs apart of which both hold one, and, of keys of several components, those that fit across the ends of components only.
    """
    a, b = numbered(a), numbered(b)
    columns = ["nkey_a", "nkey_b", "id_a", "id_b"]
    one = patterns_with_texts(a, b).select(F.col("p").alias("id_a"), F.col("k").alias("id_b"), F.lit(True).alias("left"))
    one = one.union(patterns_with_texts(b, a).select("k", "p", F.lit(False))).join(_named(a, "a"), "id_a").join(_named(b, "b"), "id_b")
    p, k = F.when(F.col("left"), F.col("nkey_a")).otherwise(F.col("nkey_b")), F.when(F.col("left"), F.col("nkey_b")).otherwise(F.col("nkey_a"))
    fits = components_fit(p, k)
    python = patterns_with_patterns(a, b).where("nkey_a != nkey_b")
    if parts != (1, 1):
        one = kept(one.withColumn("fits", fits).where(F.col("fits") | may_fit(p, k)))
        python, fits = python.union(one.where("not fits").select(columns)), F.col("fits")
    by_python = python.withColumn("kind", pattern_match(F.col("nkey_a"), F.col("nkey_b"))).where("kind is not null")
    return one.where(fits).select("nkey_a", "nkey_b", F.lit("component_wildcard").alias("kind"), "id_a", "id_b").union(by_python.select("nkey_a", "nkey_b", "kind", "id_a", "id_b"))


def scored(a: DataFrame, b: DataFrame, spec: ReconSpec) -> DataFrame:
    """(id_a, id_b, rank, literals, patterns) of numbered keys: every classified pair that is not pruned."""
    if spec.max_comparisons is not None:
        n_a, n_b = (k.count() for k in (a, b))
        if n_a * n_b > spec.max_comparisons:
            raise ReconError(f"flexible matching would compare more than {spec.max_comparisons} key pairs; at least {spec.max_comparisons + 1}")
    same = _named(a, "a").join(_named(b, "b"), F.col("nkey_a") == F.col("nkey_b"))
    parts = (len(spec.keys_a), len(spec.keys_b))
    columns = ["nkey_a", "nkey_b", "kind", "id_a", "id_b"]
    every = same.withColumn("kind", F.lit("exact")).select(columns).union(token_candidates(a, b, parts)).union(pattern_candidates(a, b, parts))
    rank = F.coalesce(*(F.when(F.col("kind") == k, r) for k, r in RANKS.items()))
    both = F.filter(F.concat("nkey_a", "nkey_b"), lambda c: F.contains(c, F.lit(ANY)))
    literals = F.aggregate(both, F.lit(0), lambda n, c: n + F.length(F.replace(c, F.lit(ANY), F.lit(""))))
    stars = F.aggregate(both, F.lit(0), lambda n, c: n + F.floor((F.length(c) - F.length(F.replace(c, F.lit(ANY), F.lit("")))) / 2).cast("int"))
    found = kept(every.select("id_a", "id_b", rank.alias("rank"), literals.alias("literals"), stars.alias("patterns")))
    if parts == (1, 1):
        pairs, several = lone_word_candidates(a, b)
        # neither key may have another word's pair, another partner by the same word, or any other candidate
        pairs = pairs.select("*", *(F.count("*").over(W.partitionBy(f"id_{s}")).alias(f"n_{s}") for s in "ab")).where("n_a = 1 and n_b = 1")
        for s, many in zip("ab", several, strict=True):
            pairs = pairs.join(many.union(found.select(f"id_{s}")), f"id_{s}", "left_anti")
        found = found.union(pairs.select("id_a", "id_b", *(F.lit(0).alias(c) for c in ("rank", "literals", "patterns"))))
    if spec.max_candidates is not None and found.limit(spec.max_candidates + 1).count() > spec.max_candidates:
        raise ReconError(f"flexible matching found more than {spec.max_candidates} candidates; at least {spec.max_candidates + 1}")
    return found


def candidates(a: DataFrame, b: DataFrame, spec: ReconSpec) -> DataFrame:
    """(id_a, id_b, rank, literals, patterns, nkey_a, nkey_b) of groups: every classified pair that is not pruned."""
    a, b = numbered(a), numbered(b)
    return scored(a, b, spec).join(_named(a, "a"), "id_a").join(_named(b, "b"), "id_b")


def matched_groups(a: DataFrame, b: DataFrame, spec: ReconSpec) -> DataFrame:
    """Groups side by side, with the place of each pair in the order of preference; unmatched groups have one side."""
    keys = [numbered(k) for k in (a, b)]
    # numbers stand for keys and follow their first rows
    pairs = scored(*keys, spec).select(F.col("id_a").alias("nkey_a"), F.col("id_b").alias("nkey_b"), "rank", "literals", "patterns", *(F.lit(0).alias(f"first_{s}") for s in "ab"))
    # the first three preferences as one number; the first rows, which follow in the order, settle the rest
    rank = (F.col("rank") * -(1 << 40) - F.col("literals") * (1 << 20) + F.col("patterns")).cast("long")
    chosen = kept(assigned(pairs).select(F.col("nkey_a").alias("id_a"), F.col("nkey_b").alias("id_b"), rank.alias("rank")))
    chosen = chosen.join(_named(keys[0], "a"), "id_a").join(_named(keys[1], "b"), "id_b").select("nkey_a", "nkey_b", "rank")
    left = a.withColumnRenamed("nkey", "nkey_a").hint("merge").join(chosen, "nkey_a", "left")
    right = b.withColumnRenamed("nkey", "nkey_b")
    met = left.join(right, "nkey_b", "full_outer")
    return met.withColumn("nkey", F.coalesce("nkey_a", "nkey_b"))
