"""Prefix hashes against slices of the texts, and fingerprints of edited texts against plain sets of spans."""

import hashlib
import random

import pytest

from concordat.llm import spans

DOCS = "doc_id long, text string, lang string"


def test_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(60):
        x, y = ("".join(rng.choice("ab\x00🙂") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        p, q = spans.prefixes(x), spans.prefixes(y)
        for _ in range(40):
            i, j = rng.randrange(len(x)), rng.randrange(len(y))
            n = rng.randrange(1 + min(len(x) - i, len(y) - j))
            assert spans.equal_spans(p, i, q, j, n) == (x[i : i + n] == y[j : j + n])
            common = next((k for k, (a, b) in enumerate(zip(x[i:], y[j:], strict=False)) if a != b), min(len(x) - i, len(y) - j))
            assert spans.common_extension(p, i, q, j) == common
        cut, taken = rng.randrange(len(x) + 1), rng.randrange(len(y) + 1)
        made, plain = p.joined(q, cut, taken), spans.prefixes(x[:cut] + y[:taken])
        assert all((a == b).all() for a, b in zip(made.sums, plain.sums, strict=True))


def wanted(rows):
    """(doc_id, n_chars, edited text, next text) by descending id."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (key, text, *_) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(text) // 3
        out.append((key, len(text), text[: len(text) - third] + after[:third], after))
    return out


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_against_plain_edits(spark, parts):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abcdé🙂 ") for _ in range(rng.choice([0, 1, 2, 5, 30, 200, 900]))), "x") for k in rng.sample(range(1000), 60)]
    rows += [(2000, None, "x"), (2001, "", None), (None, "no id " * 30, "x")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = {r["doc_id"]: r for r in spans.fingerprint_edits(spark.createDataFrame(rows, DOCS)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(rows)
    alone = lambda text: spans.ready(text)
    for key, n, edited, after in wanted(rows):
        r, own = found[key], next(t or "" for k, t, _ in rows if k == key)
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = map(alone, (own, edited, after))
        told = lambda x: spans.written(len(x.text), x.sums.whole(), x.least)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (told(a), told(b))
        like = lambda x, y: spans.likeness(x.sums.whole(), x.least, y.sums.whole(), y.least)
        assert (r["near_edited"], r["near_next"]) == (like(a, b), like(a, c))
        assert r["lang"] == next(x for k, _, x in rows if k == key)


def test_likeness_follows_shared_spans():
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    for n in (30, 300, 3000):
        base, other = (" ".join(rng.choice(words) for _ in range(n)) for _ in range(2))
        for share in (0.0, 0.2, 0.5, 0.9):
            k = int(len(base) * share)
            x, y = spans.ready(base), spans.ready(base[:k] + other[: len(base) - k])
            assert abs(spans.likeness(x.sums.whole(), x.least, y.sums.whole(), y.least) - share) < 0.17, (n, share)
    same = spans.ready("one text")
    assert spans.likeness(same.sums.whole(), same.least, same.sums.whole(), same.least) == 1
    assert spans.ready("").least.sum() == 0


def test_repeated_rows_empty_table_and_clashes(spark):
    columns = "doc_id long, text string, part int, VALUE string, first boolean, turn long, Fingerprint string"
    rows = [(1, "abc def", 1, "v", True, 2, "f")] * 3 + [(1, "xyz uvw", 1, "v", True, 2, "f")] + [(5, "tie", 2, "w", False, 3, "g")] * 2
    found = spans.fingerprint_edits(spark.createDataFrame(rows, columns))
    assert found.columns == ["doc_id", "part", "VALUE", "first", "turn", *spans.RESULT]
    got = found.collect()
    assert len(got) == 6 and sum(r["near_next"] == 1 for r in got) == 3 and {r["VALUE"] for r in got} == {"v", "w"}
    assert spans.fingerprint_edits(spark.createDataFrame([], columns)).collect() == []
    one = spans.fingerprint_edits(spark.createDataFrame([(7, "only one " * 9)], "doc_id long, text string")).first()
    assert one["near_next"] == 1 and one["n_chars"] == 81
