"""Tokens, quality, near copies, lines, toxicity and packing against plain versions, and odd inputs."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F

from concordat.llm import bpe, lines, packing, quality, simhash, similar, toxicity
from concordat.operators.graph import components

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string"
ODD = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (3, " \n\t ", "x"), (None, "no id", None), (4, "word " * 30_000, "x"), (5, "é漢字\u00a0🙂'll 12ab", None)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "en")[:3] for r in rows], DOCS)


def test_bpe_against_the_library(spark):
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello, world! it's 2024", "naïve Straße  漢字かな  \n\n x", "aaaaaaaaaaaaaaaaaaaaa" * 20, "🙂🙃 <|endoftext|> \u00a0\u2003 a", "unforeseeable zxqvw kkkk", *(r[1] for r in ODD)]
    table = docs(spark, [(i, t) for i, t in enumerate(texts)]).withColumn("IDS", F.lit("clash"))
    for cache in (0, 3, 1000):
        coded = bpe.decode(bpe.encode(table, PATH, public_tokenizers.PATTERN, cache_pieces=cache), PATH)
        assert sorted(coded.columns) == ["decoded", "doc_id", "ids", "lang", "text"]
        for r in coded.collect():
            text = r["text"] or ""
            assert list(np.frombuffer(r["ids"], "<u4")) == library.encode_ordinary(text)
            assert bytes(r["decoded"]).decode() == text
    assert bpe.encode(docs(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_a_text_cut_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PART_BYTES", 50)
    monkeypatch.setattr(bpe, "PART_PIECES", 7)
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["one two three " * 40 + "x" * 500, "short", "a  b\n\n" * 60]
    rows = bpe.encode(docs(spark, list(enumerate(texts))), PATH, public_tokenizers.PATTERN, keep_text=False).orderBy("doc_id").collect()
    assert rows[0].__fields__ == ["doc_id", "lang", "ids"]
    assert [list(np.frombuffer(r["ids"], "<u4")) for r in rows] == [library.encode_ordinary(t) for t in texts]


def test_bpe_fold_equals_merge_in_arrays(spark):
    ranks = bpe.read_ranks(PATH)
    pieces = [" quality", "zzyzx", "aaaaaaa", "ünïcödé", "!!!???", "x"]
    folded = spark.createDataFrame([(p,) for p in pieces], "p string").select("p", bpe.merged(F.col("p"), ranks).alias("ids")).collect()
    plain = bpe.merge_pieces([p.encode() for p in pieces], ranks, *bpe.pair_table(ranks))
    whole = {p: [ranks[p.encode()]] for p in pieces if p.encode() in ranks}
    for r in folded:
        assert r["ids"] == whole.get(r["p"], list(np.frombuffer(plain[pieces.index(r["p"])], "<u4")))


def plain_print(text, width):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, budget):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_trie_against_every_pair():
    rng = random.Random(1)
    for budget in (0, 2, 4, 7):
        seeds = [rng.getrandbits(64) for _ in range(12)]
        values = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for s in seeds for _ in range(12)} | {0, 1, (1 << 64) - 1})
        found = simhash.trie_links(np.zeros(len(values), np.int64), np.array(values, np.uint64), budget)
        assert list(found) == reachable(values, budget)


@pytest.mark.parametrize("block", [2048, 16])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # small blocks deal every group out
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(60)) for _ in range(15)]
    texts = base + [b.upper() for b in base[:5]] + [b.replace("a", "zz", 1) for b in base] + ["", " ", "one two", "one  TWO"]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    prints = [plain_print(t, 4) for _, t in rows]
    label = reachable(prints, 4)
    for k, (key, _) in enumerate(rows):
        assert found[key]["fingerprint"] % (1 << 64) == prints[k]
        assert found[key]["component"] == min(rows[i][0] for i in range(len(rows)) if label[i] == label[k])
    kept = simhash.first_of_each(docs(spark, rows), width=4).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({r["component"] for r in found.values()})


def test_near_copies_of_odd_rows(spark):
    found = simhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    assert {r["component"] for r in found if r["fingerprint"] == 0} == {1}
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in simhash.first_of_each(docs(spark, ODD)).collect()) == [(False, 1), (False, 4), (False, 5), (True, None)]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.first_of_each(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(None, 3), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if x is not None and e[0] != e[1] and None not in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label


def plain_lines(rows, least):
    """(key, deleted line numbers): every part of a text that reaches ``least`` words, forward or backward."""
    strip = lambda t: [x.strip(" \t\r\f\x0b") for x in (t or "").split("\n") if x.strip(" \t\r\f\x0b")]
    seen, gone = {}, {}
    for key, text in sorted(rows):
        part, own = strip(text), set()
        for i in range(len(part)):
            for ends in (range(i + 1, len(part) + 1), range(i, -1, -1)):
                for j in ends:
                    a, b = (i, j) if j > i else (j, i + 1)
                    if sum(len(x.split()) for x in part[a:b]) >= least:
                        own.add((a, b))
                        break
        for a, b in sorted(own):
            first = seen.setdefault(tuple(part[a:b]), (key, a))
            if first != (key, a):
                gone.setdefault(key, set()).update(range(a, b))
    return gone


def lines_of_maximal_runs(rows, least):
    """(key, deleted line numbers) from maximal repeated runs: those that no line before or after all their copies extends.

    A later copy of a run of ``least`` words goes, unless it overlaps the first one so far that fewer than ``least`` words lie between their starts.
    """
    texts = {key: [x.strip(" \t\r\f\x0b") for x in (t or "").split("\n") if x.strip(" \t\r\f\x0b")] for key, t in rows}
    copies, gone = {}, {}
    for key in sorted(texts):
        part = texts[key]
        for i in range(len(part)):
            for j in range(i + 1, len(part) + 1):
                copies.setdefault(tuple(part[i:j]), []).append((key, i))
    for run, at in copies.items():
        before = {texts[k][i - 1] if i else (k, "start") for k, i in at}
        after = {texts[k][i + len(run)] if i + len(run) < len(texts[k]) else (k, "end") for k, i in at}
        if len(at) == 1 or len(before) == 1 or len(after) == 1:
            continue
        first = at[0]
        for key, i in at[1:]:
            apart = i - first[1] if key == first[0] else len(run)
            if sum(len(x.split()) for x in run[:apart]) >= least:
                gone.setdefault(key, set()).update(range(i, i + len(run)))
    return gone


@pytest.mark.parametrize("least", [1, 5, 9])
def test_lines_of_maximal_runs(spark, least):
    rng = random.Random(least)
    passage = [f"line {rng.random()} of it" for _ in range(70)]  # longer than any part that the operator ranks
    short = [rng.choice(["a", "b c"]) for _ in range(40)]
    rows = [(k, "\n".join([f"own {k}", *passage[k : 60 + k], *short[k : k + 20], *["q"] * (3 * k)])) for k in range(9)]
    for k in range(9, 60):
        pool = [f"{x} {k % 12}" for x in rng.sample(["a", "b c", "d e f", "g h i j k", "z"], rng.randrange(1, 4))]
        rows.append((k, "\n".join(rng.choice([*pool, *pool, f"only {rng.random()}"]) for _ in range(rng.randrange(14)))))
    found = lines.dedup_lines(docs(spark, rows), min_words=least, deleted="gone").collect()
    assert {r["doc_id"]: set(r["gone"]) for r in found if r["gone"]} == lines_of_maximal_runs(rows, least)


@pytest.mark.parametrize("least", [1, 5, 9])
def test_lines_against_a_plain_version(spark, least):
    rng = random.Random(least)
    pool = ["a", "b c", "d e f", "g h i j k", "one two three four five six", "z"]
    rows = [(k, "\n".join(rng.choice([*pool, "", f"only {rng.random()}"]) for _ in range(rng.randrange(12)))) for k in range(25)]
    found = lines.dedup_lines(docs(spark, rows), min_words=least, deleted="gone").collect()
    wanted = plain_lines(rows, least)
    assert {r["doc_id"]: set(r["gone"]) for r in found if r["gone"]} == wanted
    for r in found:
        text = dict(rows)[r["doc_id"]]
        assert r["text"] == (lines.without_lines(text, wanted[r["doc_id"]]) if r["doc_id"] in wanted else text)


def test_lines_of_clashing_columns(spark):
    rows = docs(spark, [(1, "five words in this line\nx"), (2, "five words in this line\ny")])
    for name in ("d", "t", "lines", "_t", "gone"):
        found = lines.dedup_lines(rows.withColumn(name, F.lit(5)), deleted="gone")
        assert {r["doc_id"]: (r["text"], r["gone"], name == "gone" or r[name]) for r in found.collect()} == {
            1: ("five words in this line\nx", [], name == "gone" or 5), 2: ("y", [0], name == "gone" or 5)}


def test_lines_of_odd_rows(spark):
    found = lines.dedup_lines(docs(spark, ODD))
    assert found.columns == ["doc_id", "text", "lang"] and sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, [(*r,) for r in ODD]))
    twice = lines.dedup_lines(docs(spark, [(1, "five words in this line\nx"), (2, "y\n\nfive words in this line\n\nend")]))
    assert {r["doc_id"]: r["text"] for r in twice.collect()} == {1: "five words in this line\nx", 2: "y\n\nend"}
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def labelled(spark, good, bad, n=60):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(good) for _ in range(30)) + (f". You {rng.choice(bad) if i % 3 == 0 else 'nice'} thing.")) for i in range(n)]
    return docs(spark, rows), spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


WORDS = ["river", "house", "green", "walk", "paper", "light", "stone", "garden", "music", "number"]


def test_quality(spark):
    table, labels = labelled(spark, WORDS, ["$$$$ win!!! $$$$ cash!!! $$$$ now!!!"])
    model = quality.fit(table, labels, F.col("doc_id") < 40)
    found = {r["doc_id"]: r["score"] for r in quality.score(table, model).collect()}
    assert min(found[i] for i in range(40, 60) if i % 3) > max(found[i] for i in range(40, 60) if i % 3 == 0)
    odd = quality.score(docs(spark, ODD).withColumn("SCORE", F.lit(9)), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    none = quality.fit(table, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(table, none).collect()} == {0.5}
    assert quality.score(docs(spark, []), model).count() == 0


def test_toxicity(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "DOCS", 2)  # the table is small
    monkeypatch.setattr(toxicity, "ODDS", 1.5)
    table, labels = labelled(spark, WORDS, ["grukle", "snarfle", "blorptic"])
    model = toxicity.fit(table, labels, F.col("doc_id") < 40)
    for r in toxicity.tag(table.where("doc_id >= 40"), model).collect():
        assert (r["score"] >= 0.5) == (r["doc_id"] % 3 == 0)
        assert [r["text"][s["start"] : s["end"]] in ("grukle", "snarfle", "blorptic") for s in r["spans"]] == [True] * (r["doc_id"] % 3 == 0)
    odd = toxicity.tag(docs(spark, ODD).withColumn("spans", F.lit(1)), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.fit(table, labels.limit(0), F.lit(True)) is None
    assert toxicity.tag(docs(spark, []), None).count() == 0


def in_tasks(monkeypatch, module):
    plain = module.train

    def train(*parts):
        assert TaskContext.get() is not None
        return plain(*parts)

    monkeypatch.setattr(module, "train", train)


def test_training_leaves_the_sample_on_the_executors(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "DOCS", 2)
    monkeypatch.setattr(toxicity, "ODDS", 1.5)
    table, labels = labelled(spark, WORDS, ["grukle", "snarfle", "blorptic"])
    for module in (quality, toxicity):
        before = module.fit(table, labels, F.col("doc_id") < 40)
        in_tasks(monkeypatch, module)
        again = module.fit(table.repartition(7), labels, F.col("doc_id") < 40)
        assert all(np.array_equal(a, b) for a, b in zip(before, again, strict=True))


def test_forward_and_backward_against_all_paths():
    rng = np.random.default_rng(5)
    edges = np.array([0, 3, 3, 4, 9])
    odds, move = np.exp(rng.normal(size=9)), np.exp(rng.normal(size=(2, 2)))
    ahead, back = toxicity.ratios(odds, edges, move)
    p = ahead * back / (1 + ahead * back)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        total, ones = 0.0, np.zeros(b - a)
        for path in range(1 << (b - a)):
            s = [path >> t & 1 for t in range(b - a)]
            w = np.prod([odds[a + t] ** s[t] for t in range(b - a)]) * np.prod([move[s[t - 1], s[t]] for t in range(1, b - a)])
            total, ones = total + w, ones + w * np.array(s)
        assert np.allclose(p[a:b], ones / total)


def test_packing(spark):
    rng = random.Random(6)
    sizes = [rng.randrange(1, 900) for _ in range(400)]
    bins, starts, capacity = packing.best_fit(sizes, (128, 256, 512, 1024))
    for b in set(bins):
        inside = sorted((starts[k], sizes[k]) for k in range(len(sizes)) if bins[k] == b)
        assert all(x[0] + x[1] == y[0] for x, y in zip(inside, inside[1:], strict=False))  # no gap, no overlap
        used = sum(s for _, s in inside)
        assert used <= capacity[b] and capacity[b] == min(c for c in (128, 256, 512, 1024) if c >= used)
    assert sum(sizes) / sum(capacity[b] for b in set(bins)) > 0.95
    assert len({capacity[b] for b in set(bins)}) > 1
    # sizes of 500: what a bin would hold decides, not the largest length
    assert set(packing.best_fit([500] * 64, (512, 1024, 8192))[2]) == {1024}
    rows = packing.pack(docs(spark, ODD), lengths=(64, 128, 1024), shard=2).collect()
    assert sum(r["length"] for r in rows) == 30_000 + 2 + 2
    assert sorted(r["part"] for r in rows if r["doc_id"] == 4) == list(range(30))
    assert all((r["bin"] is None) == (r["length"] == 0) for r in rows) and sum(r["doc_id"] == 3 for r in rows) == 2
    assert packing.pack(docs(spark, [])).count() == 0


def jaccard_groups(texts, width, similarity):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = sets[i] | sets[j]
            if not union or 10 * len(sets[i] & sets[j]) >= round(10 * similarity) * len(union):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("block", [2048, 4])
@pytest.mark.parametrize("rounds", [0, 2])
def test_similar_documents_against_every_pair(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    rng = random.Random(9)
    texts = ["", " ", "one two", "one  TWO", "one three"]
    for _ in range(12):
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randrange(6, 90))]
        for edits in (0, 0, 1, 1, 2, 3):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            texts.append(" ".join(words + ["more"] * rng.randrange(3)))
    rows = list(enumerate(texts))
    label = jaccard_groups(texts, 5, 0.8)
    assert len(set(label)) < len({t.lower() for t in texts}) - 12
    kept = simhash.first_of_each(docs(spark, rows), width=5, similarity=0.8).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(label))
    assert simhash.first_of_each(docs(spark, []), similarity=0.8).count() == 0


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_one_row_of_each_group_whatever_its_key(spark, similarity):
    rng = random.Random(11)
    new = lambda: " ".join(f"{rng.choice(WORDS)}{rng.random()}" for _ in range(30))
    copied, alone, other = new(), new(), new()
    rows = [(None, new()) for _ in range(20)] + [(None, copied), (1, copied), (7, copied), (7, alone), (7, alone), (8, other), (None, other)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.first_of_each(docs(spark, rows), similarity=similarity).collect())
    assert kept == sorted([*((0, t) for _, t in rows[:20]), (1, copied), (7, alone), (8, other)])


def test_lines_of_repeated_rows_and_overlapping_runs(spark):
    run, third = "a b\nc\nd e", "a b\nc\nx y"  # told apart by their third line only
    rows = [(1, f"first {0}\n{run}"), (2, f"{run}\nlast"), (2, f"{run}\nlast"), (3, f"{third}\nend"), (3, f"{third}\nend"), (4, "\n".join(["p q"] * 4))]
    found = lines.dedup_lines(docs(spark, rows), deleted="gone").collect()
    assert len(found) == len(rows)
    wanted = {1: [], 2: [0, 1, 2], 3: [], 4: []}
    assert all(r["gone"] == wanted[r["doc_id"]] for r in found)
    rng = random.Random(8)
    pool = ["a", "b c", "d e f", "z", "y x"]
    rows = [(k, "\n".join([f"only {k}", *(rng.choice(pool) for _ in range(rng.randrange(9)))])) for k in range(30)]
    once = {r["doc_id"]: r["gone"] for r in lines.dedup_lines(docs(spark, rows), deleted="gone").collect()}
    twice = lines.dedup_lines(docs(spark, rows + rows[::2] + rows[::4]), deleted="gone").collect()
    assert len(twice) == 53 and all(r["gone"] == once[r["doc_id"]] for r in twice) and any(once.values())


def test_near_copies_of_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    plain = docs(spark, [(1, text), (2, text), (2, text), (3, None), (4, " "), (5, "quite another text of seven words")])
    odd = plain
    for name in ("fingerprint", "component", "least", "row", "turn", "key", "t", "group", "cls"):
        odd = odd.withColumn(name, F.lit("clash"))
    found = [sorted(map(tuple, simhash.near_duplicates(d).collect())) for d in (plain, odd)]
    assert found[0] == found[1] and [(r[0], r[2]) for r in found[0]] == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 5)]
    for similarity in (None, 0.8):
        stay = simhash.first_of_each(odd, similarity=similarity)
        assert stay.columns == odd.columns and sorted(r["doc_id"] for r in stay.collect()) == [1, 3, 5]


def test_similar_documents_are_named_by_fingerprints_first(spark, monkeypatch):
    rng = random.Random(15)
    base = [[f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(90)] for _ in range(40)]
    near = [[*b[:44], f"new{k}", *b[45:]] for k, b in enumerate(base)]
    texts = docs(spark, [(k, " ".join(t)) for k, t in enumerate(base + near)])
    cls = {r["cls"]: r["doc_id"] for r in texts.select("doc_id", similar.class_of(F.col("text")).alias("cls")).collect()}
    named = {tuple(sorted((cls[r["a"]], cls[r["b"]]))) for r in simhash.likely_pairs(texts, 5).collect()}
    assert len(named & {(k, k + 40) for k in range(40)}) >= 30 and len(named) <= 45
    # the stage takes them, and what they lack is found all the same
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **b: asked.append(1) or links(*a, **b).limit(3))
    kept = simhash.first_of_each(texts, width=5, similarity=0.8).collect()
    assert asked and sorted(r["doc_id"] for r in kept) == list(range(40))


def test_components_of_a_small_table_take_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few tasks", "components")
        found = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()
        tracker = context.statusTracker()
        stages = {i for j in tracker.getJobIdsForGroup("few tasks") for i in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for i in stages if (x := tracker.getStageInfo(i)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["component"] for r in found} == {0} and len(found) == 41
    assert tasks < 1000, tasks


def test_parities_never_say_more_than_sets_differ():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 20, 140, 150, 3000)]
    sets += [np.unique(np.r_[x[: len(x) * 9 // 10], rng.integers(0, 1 << 63, len(x) // 10).astype(np.uint64)]) for x in sets]
    a, b = np.triu_indices(len(sets), 1)
    least = similar.least_difference(np.array([similar.parity(x) for x in sets], object), a, b)
    differ = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert (least <= differ).all()
    near = (a == 3) & (b == 9)
    assert least[near] >= 0.8 * differ[near]
