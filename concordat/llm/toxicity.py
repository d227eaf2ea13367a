"""Toxicity: a linear-chain conditional random field tags toxic tokens.

Training tokens take their labels from labelled documents: in toxic ones, a word that is far more
frequent there than in clean ones (smoothed log odds of document counts).  The field has two
states; a token's emission adds a weight for its word and the mean weight of its byte n-grams (hashed), and
transitions are learned.  It is fitted by AdaGrad on the exact likelihood of a bounded sample of sentences, and again with
the words of clean documents that it took for toxic, either time in a task that only the field's weights leave.
Inference runs forward and backward over every sentence of the whole text; with two states both passes
are recursions of one ratio, taken for all sentences of a batch together.  A document's score is its highest
marginal, as calibrated by a logistic curve on the sample's documents and the true shares of the
classes, and its offending spans are the tokens whose calibrated marginal is at least one half.

Defined results: null and wordless texts score 0 and have no spans; repeated rows get
equal results; without labels of both classes every score is 0; an empty table gives an empty table; extra columns
are kept, but for those of the results' names, which the results replace.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import unused, without
from concordat.llm.quality import bucket_of, labelled_sample, sampled_texts
from concordat.llm.subwords import chunks, features, parts, split_words

BUCKETS = 1 << 18
#: Labelled documents of each class, and sentences with and without a toxic word that training may see.
SAMPLE, SENTENCES = 3000, (6000, 20_000)
#: A longer sentence is learned from, in whole, as sequences of so many words.
LONGEST = 64
#: A toxic word's log odds and the toxic documents that it is in, at least; toxic words at most.
ODDS, DOCS, WORDS = 3.0, 4, 5000
ROUNDS, RATE = 60, 0.5
#: Words of clean documents that the second fit adds, at most, and the emission from which they count.
HARD, DOUBT = 20_000, -3.0
#: How strongly the calibration's slope is held near 1.
HOLD = 0.01
_PUNCTUATION = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def toxic_words(texts: DataFrame, text: str) -> list[str]:
    """Words that mark toxic documents, the most telling first."""
    word = F.explode(F.array_distinct(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, _PUNCTUATION, ""))))
    counts = texts.select("y", word.alias("w")).where("w != ''").groupBy("w").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good"))
    sizes = texts.agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good")).first()
    odds = F.log((F.col("bad") + 0.5) / (sizes["bad"] + 1)) - F.log((F.col("good") + 0.5) / (sizes["good"] + 1))
    rows = counts.where((F.col("bad") >= DOCS) & (odds >= ODDS)).orderBy(odds.desc(), "w").limit(WORDS)
    return [r["w"] for r in rows.select("w").collect()]


def plain(words: pa.Array) -> pa.Array:
    """Lower-cased words without punctuation at their ends."""
    return pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.large_string())), _PUNCTUATION, "")


def sentences(texts: DataFrame, text: str, words: list[str]) -> DataFrame:
    """(tokens, tags): a bounded sample of training sentences, those of the lowest hash."""
    listed = F.lit(words) if words else F.array().cast("array<string>")
    tokens = F.transform(F.filter(F.split(F.col("s"), r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(F.lower(w), _PUNCTUATION, ""))
    rows = (
        texts.select("y", F.explode(F.split(text, r"(?<=[.!?])\s+")).alias("s"))
        .select("y", tokens.alias("whole"))
        .where(F.size("whole") > 0)
        .select("y", F.explode(F.transform(F.sequence(F.lit(1), F.size("whole"), F.lit(LONGEST)), lambda i: F.slice("whole", i, LONGEST))).alias("tokens"))
        .withColumn("bad", F.arrays_overlap("tokens", listed) & (F.col("y") == 1))
    )
    order = [F.xxhash64("tokens"), F.col("tokens")]
    some = [rows.where(F.col("bad") == kind).distinct().orderBy(*order).limit(most) for kind, most in zip((True, False), SENTENCES, strict=True)]
    return some[0].union(some[1]).select("tokens", "bad")


def ratios(odds: np.ndarray, edges: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every token, the forward and the backward ratio of state 1 to state 0.

    odds: exp of the emissions; edges of the sentences; move: exp of the transitions, from row to column.
    """
    sizes = np.diff(edges)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    start, size = edges[:-1][order], sizes[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if len(size) else np.zeros(0, int)
    ahead, back = np.empty_like(odds), np.ones_like(odds)
    last = np.ones(len(start))
    for t, n in enumerate(active):
        at = start[:n] + t
        r = last[:n]
        last = odds[at] if t == 0 else odds[at] * (move[0, 1] + r * move[1, 1]) / (move[0, 0] + r * move[1, 0])
        ahead[at] = last
    for t in range(len(active) - 2, -1, -1):
        at = start[: active[t + 1]] + t
        r = odds[at + 1] * back[at + 1]
        back[at] = (move[1, 0] + r * move[1, 1]) / (move[0, 0] + r * move[0, 1])
    return ahead, back


def words_of(owner: np.ndarray) -> int:
    """Of the features, which list every word first and then the n-grams, how many are words."""
    back = np.flatnonzero(np.r_[False, owner[1:] <= owner[:-1]])
    return int(back[0]) if len(back) else len(owner)


def emissions(words: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    values = np.zeros(len(words))
    for at, some in parts(words):
        owner, bucket = features(some, BUCKETS)
        split = words_of(owner)
        total = np.bincount(owner[split:], weights[bucket[split:]], len(some))
        value = total / np.maximum(np.bincount(owner[split:], minlength=len(some)), 1)
        value[owner[:split]] += weights[bucket[:split]]
        values[at] = value
    return values + bias


def train(rows: pa.Table, toxic: list[str]) -> tuple[np.ndarray, float, np.ndarray]:
    """(bucket weights, bias, exp of the transitions)."""
    lists = rows.column("tokens").combine_chunks()
    edges = np.asarray(lists.offsets, np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, words = np.asarray(coded.indices), coded.dictionary
    bad = np.repeat(np.asarray(rows.column("bad").combine_chunks().to_numpy(zero_copy_only=False)), np.diff(edges))
    y = np.isin(codes, np.flatnonzero(np.isin(words.to_numpy(zero_copy_only=False), toxic))) & bad
    owner, bucket = features(words, BUCKETS)
    split = words_of(owner)
    number = np.maximum(np.bincount(owner[split:], minlength=len(words)), 1)
    size = np.r_[np.ones(split), 1 / number[owner[split:]]].astype(np.float32)  # what a bucket's weight adds to its word
    inner = np.setdiff1d(np.arange(1, len(codes)), edges)  # tokens with one before them in their sentence
    weights, bias, move = np.zeros(BUCKETS), -3.0, np.zeros((2, 2))
    seen = [np.full(BUCKETS, 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    for _ in range(ROUNDS):
        e = np.clip(np.bincount(owner, weights[bucket] * size, len(words)) + bias, -30, 30)
        odds, turn = np.exp(e)[codes], np.exp(move)
        ahead, back = ratios(odds, edges, turn)
        p = ahead * back / (1 + ahead * back)
        step = np.bincount(codes, y - p, len(words))
        grad_w = np.bincount(bucket, step[owner] * size, BUCKETS) - 0.01 * weights
        grad_b = step.sum()
        a, r = ahead[inner - 1], odds[inner] * back[inner]
        joint = np.stack([turn[0, 0] + 0 * a, turn[0, 1] * r, a * turn[1, 0], a * turn[1, 1] * r])
        joint /= joint.sum(0)
        true = np.bincount(2 * y[inner - 1] + y[inner], minlength=4)
        grad_t = (true - joint.sum(1)).reshape(2, 2)
        for k, (grad, rate) in enumerate(((grad_w, RATE), (grad_b, 0.1), (grad_t, 0.1))):
            seen[k] = seen[k] + grad**2
            change = rate * grad / np.sqrt(seen[k])
            if k == 0:
                weights = weights + change
            elif k == 1:
                bias += change
            else:
                move = move + change
    return weights.astype(np.float32), float(bias), np.exp(move)


def trained(rows: DataFrame, toxic: list[str], clean: list[str]) -> tuple[np.ndarray, float, np.ndarray]:
    """``train`` in a task, on rows of ``sentences`` in an order of their own and then on the words of clean, as sentences of one word."""
    schema = pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("move", pa.list_(pa.float64()))])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("tokens", pa.list_(pa.string())), ("bad", pa.bool_())])
        more = pa.record_batch([pa.array([[w] for w in clean], kinds.types[0]), pa.array([False] * len(clean), pa.bool_())], kinds)
        weights, bias, move = train(pa.Table.from_batches([*(b.cast(kinds) for b in batches), more], kinds), toxic)
        yield pa.RecordBatch.from_pylist([{"weights": weights.tobytes(), "bias": bias, "move": move.ravel().tolist()}], schema)

    whole = rows.repartition(1).sortWithinPartitions("bad", F.xxhash64("tokens"), "tokens")
    found = whole.mapInArrow(fitted, "weights binary, bias double, move array<double>").first()
    return np.frombuffer(found["weights"], np.float32), found["bias"], np.array(found["move"]).reshape(2, 2)


def hard_words(texts: DataFrame, text: str, model) -> list[str]:
    """Words of clean documents that the model suspects, the most suspect first."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in chunks(batch, 0)):
            words = plain(split_words(part.column(0))[0]).unique()
            value = emissions(words, *shared.value[:2])
            doubt = np.flatnonzero(value > DOUBT)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(doubt)).cast(pa.string()), pa.array(value[doubt])], ["w", "e"])

    found = texts.where("y = 0").select(text).mapInArrow(suspected, "w string, e double").where("w != ''").groupBy("w").agg(F.max("e").alias("e"))
    return [r["w"] for r in found.orderBy(F.desc("e"), "w").limit(HARD).collect()]


def curve(texts: DataFrame, text: str, model, share: float) -> tuple[float, float]:
    """(slope, offset) that turn a document's highest log odds into a probability; share: of class 1 among all labelled."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in chunks(batch, 1)):
            z = pa.array(log_odds(part.column(1), shared.value)[0])
            yield pa.RecordBatch.from_arrays([part.column(0), z], ["y", "z"])

    rows = texts.select(F.col("y").cast("int").alias("y"), text).mapInArrow(highest, "y int, z double").orderBy("y", "z").toArrow()  # at most 2 * SAMPLE
    y, z = np.asarray(rows.column("y")), np.asarray(rows.column("z"))
    weight = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps; the slope is held near 1, which matters where the classes part
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        gap, bend = weight * (y - p), weight * p * (1 - p)
        grad = np.array([(gap * z).sum() - HOLD * (slope - 1), gap.sum()])
        hess = np.array([[(bend * z * z).sum() + HOLD, (bend * z).sum()], [(bend * z).sum(), bend.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        slope, offset = slope + step[0], offset + step[1]
    return float(slope), float(offset)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", key: str = "doc_id", text: str = "text"):
    """The model, or None without toxic words to learn.  usable picks the rows of labels that may be learned from."""
    sample = labelled_sample(labels, label, usable, SAMPLE, key)
    texts, text = sampled_texts(docs, sample, key, text).persist(), "text"  # of at most 2 * SAMPLE rows
    kept = [texts]
    try:
        words = toxic_words(texts, text)
        if not words:
            return None
        rows = sentences(texts, text, words).persist()
        kept.append(rows)
        model = trained(rows, words, [])
        model = trained(rows, words, hard_words(texts, text, model))
        counts = labels.where(usable).agg(F.count_if(F.col(label) == 1).alias("n"), F.count(label).alias("all")).first()
        return (*model, *curve(texts, text, model, counts["n"] / counts["all"]))
    finally:
        for df in kept:
            df.unpersist()


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def tag(docs: DataFrame, model, text: str = "text", score: str = "score", spans: str = "spans", least: float = 0.5) -> DataFrame:
    """Adds the document's score and the offsets, in code points, of its offending tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = without(docs, score, spans)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(score, T.DoubleType()), T.StructField(spans, SPANS)])
    at = kept.index(text)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                values, found = marginals(part.column(at), shared.value, least)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values), pa.array(found, kind)], schema.names)

    return docs.select(*kept).mapInArrow(tagged, schema)


def log_odds(texts: pa.Array, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(highest log odds of each text, those of every token, edges of the texts' tokens); -30 is the least."""
    words, codes, edges = split_words(texts)
    highest = np.full(len(texts), -30.0)
    if not len(codes):
        return highest, np.zeros(0), edges
    weights, bias, move = model[:3]
    odds = np.exp(np.clip(emissions(plain(words), weights, bias), -30, 30))
    ends = np.asarray(pc.match_substring_regex(words, "[.!?]$"))[codes]
    ahead, back = ratios(odds[codes], np.union1d(np.flatnonzero(ends) + 1, edges), move)
    z = np.clip(np.log(ahead) + np.log(back), -30, 30)
    z[np.asarray(pc.equal(words, ""))[codes]] = -30
    full = np.flatnonzero(np.diff(edges))
    highest[full] = np.maximum.reduceat(z, edges[:-1][full])
    return highest, z, edges


def marginals(texts: pa.Array, model, least: float) -> tuple[np.ndarray, list[list[dict]]]:
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    if model is None:
        return np.zeros(len(texts)), found
    highest, z, edges = log_odds(texts, model)
    slope, offset = model[3:]
    sure = lambda v: 1 / (1 + np.exp(-np.clip(slope * v + offset, -30, 30)))
    values = np.where(highest > -30, sure(highest), 0.0)
    for k in np.flatnonzero(values >= least):
        words, codes, _ = split_words(texts.slice(int(k), 1))
        own = np.asarray(pc.not_equal(words, ""))[codes]
        hit = np.flatnonzero(sure(z[edges[k] : edges[k + 1]][own]) >= least)
        place = [m.span() for m in re.finditer(r"\S+", texts[int(k)].as_py())]
        found[k] = [{"start": place[t][0], "end": place[t][1]} for t in hit if t < len(place)]
    return values, found


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, bucket_of("doc_id", 5) != 0)
    return tag(docs, model).select(
        "doc_id",
        (bucket_of("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that score below ``most``."""
    model = fit(docs, labels, bucket_of(key, 5) != 0, key=key, text=text)
    name = unused(docs, "toxicity")
    return tag(docs, model, text, name, unused(docs, "spans")).where(F.col(name) < most).select(*docs.columns)
