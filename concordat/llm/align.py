"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another.

The byte offsets at which tokens of both end cut a text into groups.  What a stretch of a text yields is a *fragment*: its open prefix (up to
the first common end, as what lies before is not known), the groups that are closed, and its open suffix.  Fragments
compose associatively (``compose``): suffix and prefix are put together, and every end that they share closes a group.  So a very
long text is cut into byte ranges, each is tokenized in a task of its own, and the fragments meet in a tree of ``FAN`` at a time, not
in one task.  The two token streams of a range are cut where each tokenizer can be cut, at places that may differ.  In other
texts the stretches are words between places where both can be cut; their fragments are closed on both sides, so that they compose
by concatenation, and are remembered within a task.

A pair of ids is counted by the documents that hold it linked, which follow the corpus: distinct pairs of each document are written to the shared
checkpoint folder, counted with partial sums in the tasks, and looked up again.  The most frequent pairs, ``FREQUENT`` at most, and the
highest count of each id are broadcast (the latter has a row for each token of a vocabulary); links of the other pairs are joined.

Defined results: null and empty texts, and those whose tokens do not spell them, have no tokens: zeros, and an empty digest; they count for no pair.
Repeated rows are documents of their own; columns that clash with a result's name are replaced, others are kept; an empty table gives
an empty table; special tokens are plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import unused, without
from concordat.llm.subwords import chunks
from concordat.operators.graph import cut

#: Bytes of a range of a text; longer texts are dealt out in ranges.
RANGE_BYTES = 1 << 16
#: Fragments that a task composes.
FAN = 16
#: Pairs that are broadcast with their counts; words that a task remembers; text, in bytes, that it takes at a time.
FREQUENT, REMEMBERED, PART_BYTES = 1 << 20, 1 << 17, 1 << 20
#: Words that are encoded as one text.
TOGETHER = 256
#: Distinct pairs that a task counts before it passes them on.
COUNTED = 1 << 21
# what some tokenizer may take for white space
_RANGES = ((0, 0x20), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064), (0x2581, 0x2581), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
_BLANK = frozenset(chr(c) for lo, hi in _RANGES for c in range(lo, hi + 1))
# Fixed value: how byte-level BPE files of this kind cut a text before their merges.
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT_A = re.compile(r"(?<=[\w!-~])(?=[ \n])")
_CUT_B = re.compile(r"(?s)(?<=[^ ▁])(?= .)")
RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Tokenizers(NamedTuple):
    """Contents of a byte-level BPE JSON file (A) and of a piece model (B); whether A's merges follow its ids (``ranked``)."""

    a: bytes
    b: bytes
    by_rank: bool = False


def ranked(a: bytes) -> bool:
    """Whether merging by the id of what two neighbours make gives the file's own tokens.

    It does if ids follow the order of the merges and every entry alone is merged to itself: were two neighbours to make an entry otherwise than by its
    merge, the entry alone would, as no merge crosses its edges, have come to these two as well.
    """
    from tokenizers import Tokenizer

    told = json.loads(a)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    if told.get("normalizer") or told.get("post_processor") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if model["type"] != "BPE" or model.get("ignore_merges") or any(t["normalized"] or not t["special"] for t in told["added_tokens"]):
        return False
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get("".join(p), -1) for p in pairs]
    added = {t["content"] for t in told["added_tokens"]}
    entries = [e for e in model["vocab"] if e not in added]
    if ids != sorted(set(ids)) or sum(len(e) == 1 for e in entries) != 256:
        return False
    alone = Tokenizer.from_str(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": model}))
    return all(e.ids == [model["vocab"][entry]] for entry, e in zip(entries, alone.encode_batch_fast(entries), strict=True))


def tokenizers(a: bytes, b: bytes) -> Tokenizers:
    return Tokenizers(a, b, ranked(a))


class Coder(NamedTuple):
    encode: Callable[[list[str]], list[list[int]]]
    token: list[bytes]
    size: np.ndarray


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _coder(encode, token: list[bytes]) -> Coder:
    return Coder(encode, token, np.array([len(t) for t in token], np.int64))


@lru_cache(maxsize=2)
def coders(files: Tokenizers) -> tuple[Coder, Coder]:
    import sentencepiece
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_str(files.a.decode())
    bpe.encode_special_tokens = True
    letters, vocabulary = byte_letters(), bpe.get_vocab(with_added_tokens=True)
    tokens_a = [b""] * (1 + max(vocabulary.values()))
    for entry, number in vocabulary.items():
        tokens_a[number] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    model = sentencepiece.SentencePieceProcessor(model_proto=files.b)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("a piece that spans words cannot be cut at a space")
    tokens_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    # both take texts that begin with a space, which the piece model adds itself
    if files.by_rank:
        import tiktoken

        added = set(bpe.get_added_tokens_decoder())
        merging = tiktoken.Encoding("a", pat_str=_PIECES, mergeable_ranks={t: i for i, t in enumerate(tokens_a) if t and i not in added}, special_tokens={})
        encode_a = lambda texts: list(map(merging.encode_ordinary, texts))
    else:
        encode_a = lambda texts: [e.ids for e in bpe.encode_batch_fast(texts, add_special_tokens=False)]
    encode_b = lambda texts: model.encode([t[1:] for t in texts], num_threads=1)
    return _coder(encode_a, tokens_a), _coder(encode_b, tokens_b)


class Open(NamedTuple):
    """Tokens of both kinds, and the byte at which each ends."""

    a: np.ndarray
    ends_a: np.ndarray
    b: np.ndarray
    ends_b: np.ndarray


NONE = Open(*(np.zeros(0, np.int64),) * 4)


class Fragment(NamedTuple):
    """A stretch of a text.  Without a common end all of it is prefix; groups are written ``a1,a2|b1`` and joined by ``;``."""

    prefix: Open
    cut: bool
    groups: str
    n_groups: int
    n_a: int
    n_b: int
    pairs: np.ndarray  # of the closed groups, a << 32 | b, with repeats
    suffix: Open


def _joined(x: Open, y: Open) -> Open:
    return Open(*map(np.concatenate, zip(x, y, strict=True)))


def _cut_up(tokens: Open) -> tuple[list[Open], Open]:
    """The stretches that common ends close, and what is left."""
    common = np.intersect1d(tokens.ends_a, tokens.ends_b)
    at_a, at_b = (np.r_[0, np.searchsorted(e, common, "right")] for e in (tokens.ends_a, tokens.ends_b))
    part = lambda i, j, k, m: Open(tokens.a[i:j], tokens.ends_a[i:j], tokens.b[k:m], tokens.ends_b[k:m])
    closed = [part(at_a[n], at_a[n + 1], at_b[n], at_b[n + 1]) for n in range(len(common))]
    return closed, part(at_a[-1], None, at_b[-1], None)


def _written(groups: Sequence[Open]) -> tuple[str, np.ndarray]:
    text = ";".join(f"{','.join(map(str, g.a.tolist()))}|{','.join(map(str, g.b.tolist()))}" for g in groups)
    pairs = [(g.a[:, None] << 32 | g.b[None, :]).ravel() for g in groups]
    return text, np.concatenate([np.zeros(0, np.int64), *pairs])


def fragment(tokens: Open) -> Fragment:
    """What a stretch yields of which neither edge is known to be a common end."""
    closed, rest = _cut_up(tokens)
    if not closed:
        return Fragment(rest, False, "", 0, len(tokens.a), len(tokens.b), np.zeros(0, np.int64), NONE)
    text, pairs = _written(closed[1:])
    return Fragment(closed[0], True, text, len(closed) - 1, len(tokens.a), len(tokens.b), pairs, rest)


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring stretches; associative, with ``fragment(NONE)`` as its neutral element."""
    middle = fragment(_joined(x.suffix if x.cut else x.prefix, y.prefix))
    between = _written([middle.prefix]) if x.cut and middle.cut else ("", middle.pairs[:0])
    parts = [(x.groups, x.n_groups, x.pairs), (between[0], int(bool(between[0])), between[1]), (middle.groups, middle.n_groups, middle.pairs), (y.groups, y.n_groups, y.pairs)]
    last = y.suffix if y.cut else middle.suffix if middle.cut or not x.cut else middle.prefix
    return Fragment(
        x.prefix if x.cut else middle.prefix,
        x.cut or middle.cut,
        ";".join(p[0] for p in parts if p[1]),
        sum(p[1] for p in parts),
        x.n_a + y.n_a,
        x.n_b + y.n_b,
        np.concatenate([p[2] for p in parts]),
        last if x.cut or middle.cut else NONE,
    )


def finished(whole: Fragment) -> tuple[str, int, np.ndarray]:
    """(groups, their number, pairs) of a text, whose start is a common end."""
    text, pairs = _written([whole.prefix]) if whole.cut else ("", whole.pairs[:0])
    return ";".join(filter(None, (text, whole.groups))), whole.n_groups + whole.cut, np.concatenate([pairs, whole.pairs])


def ranges(text: str, most: int) -> Iterator[tuple[str, list[int], list[int]]]:
    """(stretch, [first character, end, first byte] of A's tokens, the same of B's) for byte ranges of space + text.

    A is cut before white space that follows a word or sign, B before a space that follows none; a stretch without such a place is not cut.
    """
    whole = " " + text
    at, bytes_at = [0, 0], [0, 0]
    while min(at) < len(whole):
        goal, ends = min(at) + most, []
        for start, place in zip(at, (_CUT_A, _CUT_B), strict=True):
            found = place.search(whole, goal) if start < goal else None
            ends.append(start if start >= goal else found.start() if found else len(whole))
        lo, hi = min(at), max(ends)
        yield whole[lo:hi], *([s - lo, e - lo, b] for s, e, b in zip(at, ends, bytes_at, strict=True))
        bytes_at = [b + len(whole[s:e].encode()) for s, e, b in zip(at, ends, bytes_at, strict=True)]
        at = ends


def _stream(coder: Coder, text: str, start: int) -> tuple[np.ndarray, np.ndarray, bool]:
    ids = np.array(coder.encode([text])[0] if text else [], np.int64)
    return ids, start + np.cumsum(coder.size[ids]), b"".join(map(coder.token.__getitem__, ids.tolist())) == text.encode()


def tight(word: str) -> bool:
    return bool(word) and word[0] not in _BLANK and word[-1] not in _BLANK


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[k], first[k] + 1, ... for each k, sizes[k] of them."""
    return np.arange(int(sizes.sum())) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


class Words:
    """Fragments of words, which both tokenizers can be cut between; remembered by a number for each word."""

    def __init__(self, a: Coder, b: Coder):
        self.a, self.b = a, b
        self.loose: set[str] = set()  # parts between spaces that begin or end with what may be white space, or are empty
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []  # each followed by ``;``; None: its tokens do not spell it
        self.counts, self.pairs, self.edges = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)
        # a token as it is written: its id, and what follows it in its group, or after that
        self.written = [f"{i}{mark}" for coder, last in ((a, "|"), (b, ";")) for i in range(len(coder.token)) for mark in (",", last)]

    def forget(self) -> None:
        """Keeps what was used more than once since the last time."""
        keep = np.flatnonzero(self.uses > 1)
        place = np.full(len(self.uses), -1)
        place[keep] = np.arange(len(keep))
        self.number = {w: k for w, k in zip(self.number, place.tolist(), strict=True) if k >= 0}
        self.groups = [self.groups[k] for k in keep.tolist()]
        sizes = np.diff(self.edges)[keep]
        self.pairs = self.pairs[spread(self.edges[keep], sizes)]
        self.counts, self.edges, self.uses = self.counts[keep], np.r_[0, np.cumsum(sizes)], np.zeros(len(keep), np.int64)
        self.loose.clear()
        self.loose.update(w for w in self.number if not tight(w))

    def cut_up(self, texts: list[str | None]) -> list[list[str]]:
        """Each text, a space before it, in stretches between places where both can be cut, each without its first space."""
        parts = [t.split(" ") if t else [] for t in texts]
        self.loose.update(p for p in set().union(*parts).difference(self.number) if not tight(p))
        return [p if self.loose.isdisjoint(p) else glued(p, self.loose) for p in parts]

    def learn(self, words: list[str]) -> None:
        inner = [w for w in words if tight(w)]
        alone = [w for w in words if not tight(w)]
        todo = [inner[k : k + TOGETHER] for k in range(0, len(inner), TOGETHER)] + [[w] for w in alone]
        while todo:
            texts = [" " + " ".join(part) for part in todo]
            ids, good, again = ([], []), [], []
            for part, text, a, b in zip(todo, texts, self.a.encode(texts), self.b.encode(texts), strict=True):
                if all(b"".join(map(c.token.__getitem__, i)) == text.encode() for c, i in ((self.a, a), (self.b, b))):
                    good += part
                    ids[0].append(a)
                    ids[1].append(b)
                elif len(part) > 1:
                    again += [[w] for w in part]
                else:
                    self._add(part, [None], np.zeros((1, 3), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
            self._align(good, *(np.fromiter(chain.from_iterable(i), np.int64) for i in ids))
            todo = again

    def _add(self, words: list[str], groups: list[str | None], counts: np.ndarray, pairs: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.groups), len(self.groups) + len(words)), strict=True))
        self.groups += groups
        self.counts, self.pairs = np.concatenate([self.counts, counts]), np.concatenate([self.pairs, pairs])
        self.edges = np.r_[self.edges, self.edges[-1] + np.cumsum(sizes)]
        self.uses = np.r_[self.uses, np.zeros(len(words), np.int64)]

    def _align(self, words: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Adds words, all of whose tokens, one word after the other, are a and b."""
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        ends = np.cumsum(np.fromiter((1 + len(w.encode()) for w in words), np.int64, len(words)))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        upto = [np.searchsorted(e, ends, "right") for e in (ends_a, ends_b, common)]
        counts = np.stack([np.diff(u, prepend=0) for u in upto], 1)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        first_b, after_b = (np.searchsorted(group_b, group_a, side) for side in ("left", "right"))
        sizes = after_b - first_b
        pairs = np.repeat(a, sizes) << 32 | b[spread(first_b, sizes)]
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + first_b] = 2 * a + np.r_[group_a[1:] != group_a[:-1], True][: len(a)]
        codes[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (len(self.a.token) + b) + np.r_[group_b[1:] != group_b[:-1], True][: len(b)]
        said, at = list(map(self.written.__getitem__, codes.tolist())), [0, *(upto[0] + upto[1]).tolist()]
        links = np.r_[0, np.cumsum(sizes)][upto[0]]
        self._add(words, ["".join(said[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], counts, pairs, np.diff(links, prepend=0))


def glued(parts: list[str], loose: set[str]) -> list[str]:
    """Parts of a text between spaces, put together where one of the tokenizers may not be cut."""
    out = [parts[0]]
    for before, part in zip(parts, parts[1:], strict=False):
        if before in loose or part in loose:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted distinct pairs and their numbers of links."""
    return zlib.compress(np.r_[pairs[:1], np.diff(pairs)].astype("<i8").tobytes() + times.astype("<i8").tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), "<i8").reshape(2, -1)
    return np.cumsum(both[0]), both[1]


_FOUND = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary())]
_ZERO = (0, 0, 0, 0, "", _packed(np.zeros(0, np.int64), np.zeros(0, np.int64)))
_FRAGMENT = "good boolean, cut boolean, " + ", ".join(f"{e}_{p} binary" for e in ("prefix", "suffix") for p in Open._fields) + ", groups string, n_groups long, n_a long, n_b long, pairs binary"


def _row(groups: str, n_groups: int, n_a: int, n_b: int, pairs: np.ndarray) -> tuple:
    distinct, times = np.unique(pairs, return_counts=True)
    return n_a, n_b, n_groups, len(pairs), hashlib.sha256(groups.encode()).hexdigest(), _packed(distinct, times)


def _short(docs: DataFrame, kept: list[str], text: str, shared) -> Callable:
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(*coders(shared.value))
        for batch in (part for whole in batches for part in chunks(whole, whole.num_columns - 1, PART_BYTES)):
            if len(words.number) > REMEMBERED:
                words.forget()
            cut_up = words.cut_up(batch.column(batch.num_columns - 1).to_pylist())
            words.learn(list(set().union(*cut_up).difference(words.number)))
            numbers = [list(map(words.number.__getitem__, w)) for w in cut_up]
            said = [[words.groups[k] for k in n] for n in numbers]
            good = np.array([bool(s) and None not in s for s in said], bool)
            owner = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
            flat = np.fromiter(chain.from_iterable(numbers), np.int64, len(owner))
            words.uses += np.bincount(flat, minlength=len(words.uses))
            sums = np.stack([np.bincount(owner, c, len(numbers)).astype(np.int64) for c in words.counts[flat].T], 1)
            # each word's pairs once a document, as often as the document has the word
            key, times = np.unique(owner << 32 | flat, return_counts=True)
            word = key & 0xFFFFFFFF
            sizes = words.edges[word + 1] - words.edges[word]
            pairs = words.pairs[spread(words.edges[word], sizes)]
            doc, times = np.repeat(key >> 32, sizes), np.repeat(times, sizes)
            order = np.lexsort((pairs, doc))
            pairs, doc, times = pairs[order], doc[order], times[order]
            first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (doc[1:] != doc[:-1])][: len(pairs)])
            pairs, doc = pairs[first], doc[first]
            times = np.add.reduceat(times, first) if len(first) else times
            edges = np.searchsorted(doc, np.arange(len(numbers) + 1))
            rows = [
                (*sums[k].tolist(), int(times[lo:hi].sum()), hashlib.sha256("".join(said[k])[:-1].encode()).hexdigest(), _packed(pairs[lo:hi], times[lo:hi])) if good[k] else _ZERO
                for k, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            ]
            made = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_FOUND)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [*kept, *(n for n, _ in _FOUND)])

    return aligned


def _stored(f: Fragment, good: bool) -> dict:
    parts = {f"{e}_{n}": v.tobytes() for e in ("prefix", "suffix") for n, v in zip(Open._fields, getattr(f, e), strict=True)}
    return parts | {"good": good, "cut": f.cut, "groups": f.groups, "n_groups": f.n_groups, "n_a": f.n_a, "n_b": f.n_b, "pairs": f.pairs.tobytes()}


def _loaded(r) -> Fragment:
    read = lambda raw: np.frombuffer(raw, np.int64)
    prefix, suffix = (Open(*(read(getattr(r, f"{e}_{n}")) for n in Open._fields)) for e in ("prefix", "suffix"))
    return Fragment(prefix, r.cut, r.groups, r.n_groups, r.n_a, r.n_b, read(r.pairs), suffix)


def _long(docs: DataFrame, kept: list[str], text: str, shared, most: int) -> DataFrame:
    """Rows of ``_FOUND`` for long texts, by ranges; kept columns ride with the first range."""
    own = cut(docs.select(F.monotonically_increasing_id().alias("_row"), (F.struct(*kept) if kept else F.lit(0)).alias("_kept"), F.col(text).alias("_text")))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, value in zip(batch["_row"], batch["_text"], strict=True):
                for n, (part, a, b) in enumerate(ranges(value, most)):
                    yield pd.DataFrame({"_row": [row], "n": [n], "part": [part], "a": [a], "b": [b]})

    def tokenized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = coders(shared.value)
        for batch in batches:
            for r in batch.itertuples(index=False):
                streams = [_stream(c, r.part[at[0] : at[1]], int(at[2])) for c, at in zip(both, (r.a, r.b), strict=True)]
                tokens = Open(*streams[0][:2], *streams[1][:2])
                yield pd.DataFrame([{"_row": r[0], "n": r.n} | _stored(fragment(tokens), streams[0][2] and streams[1][2])])

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        whole = fragment(NONE)
        for r in rows.itertuples(index=False):
            whole = compose(whole, _loaded(r))
        return pd.DataFrame([{"_row": rows["_row"].iloc[0], "n": rows["n"].iloc[0] // FAN} | _stored(whole, bool(rows["good"].all()))])

    def ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                f = _loaded(r)
                row = _row(*finished(f)[:2], f.n_a, f.n_b, finished(f)[2]) if r.good else _ZERO
                yield pd.DataFrame([{"_row": r[0]} | dict(zip((n for n, _ in _FOUND), row, strict=True))])

    schema = f"_row long, n long, {_FRAGMENT}"
    cut_up_rows = own.select("_row", "_text").mapInPandas(cut_up, "_row long, n long, part string, a array<long>, b array<long>")
    parts = cut(cut_up_rows.repartition(docs.sparkSession.sparkContext.defaultParallelism, "_row", "n").mapInPandas(tokenized, schema))
    last = parts.agg(F.max("n")).first()[0] or 0
    while True:
        parts = parts.groupBy("_row", F.floor(F.col("n") / FAN).alias("_n")).applyInPandas(composed, schema)
        last //= FAN
        if not last:
            break
    found = parts.mapInPandas(ended, "_row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")
    return found.join(own.select("_row", "_kept"), "_row").select(*(F.col("_kept")[k].alias(k) for k in kept), *(n for n, _ in _FOUND))


def tokens_aligned(docs: DataFrame, files: Tokenizers, text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs' other columns, n_a, n_b, n_groups, n_links, groups_sha256, and ``links``: each document's distinct pairs, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    kept = [c for c in without(docs, *RESULT, "links") if c != text]
    schema = T.StructType(
        [*(docs.schema[c] for c in kept), *(T.StructField(n, T.StringType() if k == pa.string() else T.BinaryType() if k == pa.binary() else T.LongType()) for n, k in _FOUND)]
    )
    is_long = F.coalesce(F.octet_length(text) > range_bytes, F.lit(False))
    short = docs.where(~is_long).select(*kept, text).mapInArrow(_short(docs, kept, text, shared), schema)
    return short.union(_long(docs.where(is_long), kept, text, shared, range_bytes))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): in how many documents a pair is linked."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate([sums[0], *held]), np.concatenate([sums[1], *(np.ones(len(h), np.int64) for h in held)])
            distinct, at = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(at, n, len(distinct)).astype(np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, sums)], ["pair", "n"])

        for batch in batches:
            held += [_unpacked(v)[0] for v in batch.column(0).to_pylist()]
            if sum(map(len, held)) > COUNTED:
                sums, held = summed(), []
                if len(sums[0]) > COUNTED:
                    yield told()
                    sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        sums, held = summed(), []
        yield told()

    return found.select("links").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, files: Tokenizers, text: str = "text", range_bytes: int = RANGE_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """docs' other columns and ``RESULT``: tokens, groups and links of each text, links whose pair is the most frequent of its A id, and the sum of their pairs' counts."""
    spark = docs.sparkSession
    found = tokens_aligned(docs, files, text, range_bytes)
    row = unused(found, "row")
    found = cut(found.withColumn(row, F.monotonically_increasing_id()))
    counts = cut(pair_counts(found))
    best = counts.groupBy(F.shiftright("pair", 32).cast("long").alias("a")).agg(F.max("n").alias("most"))  # one row a token of A
    size = F.floor(4 * F.log2("n")).cast("int")
    left, least = frequent, None
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):  # at most some hundreds of sizes
        if r["count"] > left:
            break
        left, least = left - r["count"], r["size"]
    often = counts.where(size >= least) if least is not None else counts.limit(0)
    numbers = lambda df: [np.asarray(c, np.int64) for c in df.toArrow().columns]
    tops, known = numbers(best), numbers(often.orderBy("pair"))
    highest = np.zeros(1 + int(tops[0].max(initial=0)), np.int64)
    highest[tops[0]] = tops[1]
    shared = spark.sparkContext.broadcast((*known, highest))

    def split(links: bytes) -> tuple[np.ndarray, ...]:
        pairs, times = _unpacked(links)
        keys, n, _ = shared.value
        at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        return pairs, times, hit, n[at[hit]] if len(keys) else n

    kept = [c for c in found.columns if c not in ("links", row)]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for links in batch.column(1).to_pylist():
                pairs, times, hit, n = split(links)
                top = n == shared.value[2][pairs[hit] >> 32]
                sums.append((int(times[hit][top].sum()), int((times[hit] * n).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1))], ["_r", "_best", "_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs, times, hit, _ = split(links)
                if not hit.all():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int((~hit).sum()), number)), pa.array(pairs[~hit]), pa.array(times[~hit])], ["_r", "pair", "times"])

    keyed = found.select(F.col(row).alias("_r"), "links")
    sums = keyed.mapInArrow(told, "_r long, _best long, _sum long")
    rest = counts.where(size < least) if least is not None else counts
    if rest.limit(1).count():
        others = keyed.mapInArrow(rare, "_r long, pair long, times long")
        marked = rest.join(F.broadcast(best), F.shiftright("pair", 32).cast("long") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("top"))
        late = others.join(marked, "pair").select("_r", (F.col("times") * F.col("top")).alias("_best"), (F.col("times") * F.col("n")).alias("_sum"))
        sums = sums.union(late)
    total = sums.groupBy("_r").agg(F.sum("_best").alias("n_best"), F.sum("_sum").alias("count_sum"))
    order = [c for c in kept if c not in RESULT]
    return found.join(total, found[row] == total["_r"]).select(*order, *RESULT)


def op13(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    read = lambda name: open(public_tokenizers.path(name), "rb").read()  # noqa: E731, SIM115
    files = tokenizers(read("byte_bpe_50k.json"), read("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, files).select("doc_id", *RESULT)
