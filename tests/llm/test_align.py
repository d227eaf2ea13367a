"""Alignment of two tokenizers against whole encodings and plain counts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from concordat.llm import align

DOCS = "doc_id long, text string, N_A string"
RAW = [open(public_tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]  # noqa: SIM115
FILES = align.tokenizers(*RAW)
ODD = [None, "", " ", "  ", "\n", " \n x", "a  b   c", "x▁y z", "tail ", " <|endoftext|> <s> </s> <0x0A>", "é漢字 かな🙂  'll 12ab\x85 q", "a　 b  c", "\x00 a\x1f b", "don't isn’t 's", "word " * 300]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, from its whole encodings."""
    bpe = Tokenizer.from_str(RAW[0].decode())
    bpe.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_proto=RAW[1])
    letters = align.byte_letters()
    rows, links = [], []
    for text in texts:
        a = [(i, bytes(letters[c] for c in bpe.id_to_token(i))) for i in bpe.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text or "")]
        want = (" " + (text or "")).encode()
        if not text or b"".join(x[1] for x in a) != want or b"".join(x[1] for x in b) != want:
            rows.append(None)
            links.append([])
            continue
        ends = [{sum(len(t[1]) for t in tokens[: k + 1]) for k in range(len(tokens))} for tokens in (a, b)]
        groups, at = [], [0, 0, 0]
        for end in sorted(ends[0] & ends[1]):
            part = []
            for tokens in (a, b):
                place, taken = 0, []
                for i, raw in tokens:
                    place += len(raw)
                    if at[2] < place <= end:
                        taken.append(i)
                part.append(taken)
            at[2] = end
            groups.append(part)
        links.append([(x, y) for p, q in groups for x in p for y in q])
        said = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        rows.append((len(a), len(b), len(groups), len(links[-1]), hashlib.sha256(said.encode()).hexdigest()))
    count = Counter(p for held in links for p in set(held))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None else (*r[:4], sum(count[p] == most[p[0]] for p in held), sum(count[p] for p in held), r[4])
        for r, held in zip(rows, links, strict=True)
    ]


def random_texts(rng, n):
    words = ["the", "unforeseeable", "naïve", "x.y", "漢字", "\n", "\t", "", "a\n\nb", "12,345", "(so)", " ", "q▁", "🙂🙃", "Ünïcödé", "'s", "é"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("range_bytes, frequent", [(1 << 16, 1 << 20), (40, 50), (7, 0)])
def test_against_whole_encodings(spark, range_bytes, frequent):
    texts = ODD + random_texts(random.Random(range_bytes), 40)
    docs = spark.createDataFrame([(k % 50, t, "x") for k, t in enumerate(texts)], DOCS)
    found = align.align(docs, FILES, range_bytes=range_bytes, frequent=frequent)
    assert found.columns == ["doc_id", *align.RESULT]
    wanted = sorted((k % 50, *r) for k, r in enumerate(plain(texts)))
    assert sorted(map(tuple, found.collect())) == wanted


def test_both_ways_of_merging_agree():
    assert FILES.by_rank
    one, other = align.coders(FILES)[0], align.coders(align.Tokenizers(*RAW))[0]
    rng = random.Random(9)
    texts = [" " + t for t in random_texts(rng, 200)] + [" " + "".join(rng.choice("aeinrst'é  \n1") for _ in range(200)) for _ in range(200)]
    assert one.encode(texts) == other.encode(texts) and one.token == other.token


def test_composition_is_associative():
    rng = random.Random(4)
    import numpy as np

    def cut_at(tokens, i, j):
        take = lambda ids, ends, lo, hi: (ids[lo:hi], ends[lo:hi])
        return align.Open(*take(tokens.a, tokens.ends_a, *i), *take(tokens.b, tokens.ends_b, *j))

    for _ in range(300):
        sizes = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))] for _ in range(2)]
        ends = [np.cumsum(s) for s in sizes]
        tokens = align.Open(np.arange(len(ends[0])), ends[0], np.arange(len(ends[1])) + 100, ends[1])
        cuts = [[0, *sorted(rng.randrange(len(e) + 1) for _ in range(3)), len(e)] for e in ends]
        parts = [align.fragment(cut_at(tokens, cuts[0][k : k + 2], cuts[1][k : k + 2])) for k in range(4)]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [align.compose(parts[k], parts[k + 1])]
        whole, one = parts[0], align.fragment(tokens)
        assert align.finished(whole)[:2] == align.finished(one)[:2]
        assert list(align.finished(whole)[2]) == list(align.finished(one)[2])
        assert [list(x) for x in (*whole.prefix, *whole.suffix)] == [list(x) for x in (*one.prefix, *one.suffix)]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, row long, Links string")
    assert align.align(empty, FILES).collect() == []
    one = spark.createDataFrame([(1, "some words", 5, "x", 7)], "doc_id long, text string, row long, Links string, _row long")
    assert align.align(one, FILES).first()["row"] == 5
    many = spark.createDataFrame([(1, "some words " * 40, 5)], "doc_id long, text string, _row long")
    assert align.align(many, FILES, range_bytes=50).first()["_row"] == 5
