"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its words and their byte n-grams (hashed), of which two vectors for how
it repeats its words take a fixed share; a softmax over two classes stands on it.  The vectors are trained by numpy stochastic gradient descent on a
bounded sample of labelled rows, as many of either class, in a task that only the model leaves; the bias is then set to the classes'
true shares.  As the softmax is linear in
the average, scoring needs one number per hash bucket: the model that is broadcast is
``BUCKETS`` numbers whatever the corpus.  Scoring runs in Arrow batches over whole texts.

Defined results: null and empty texts get the score of the class bias alone; repeated rows get
equal scores; an empty table gives an empty table; extra columns are kept, but for one of the score's name, which the score replaces; a sampled key with
several texts is learned from by one of them; labels repeated for a document count once, by their largest value; labels without a text are not used;
with labels of one class only every score leans to that class; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import unused, without
from concordat.llm.subwords import chunks, features, parts, split_words

BUCKETS = 1 << 18
#: Labelled rows of each class that training may see.
SAMPLE = 1000
DIM, STEPS, RATE, SEED = 8, 15_000, 1.0, 7
#: Share of the average that the two vectors for repetition take, and how many there are of either.
SHAPE_SHARE, SHAPES = 0.2, 16


def shapes(codes: np.ndarray) -> tuple[int, int]:
    """Buckets, counted from the last, for a text's words per distinct word and for its commonest word's share."""
    if not len(codes):
        return SHAPES - 1, 2 * SHAPES - 1
    counts = np.unique(codes, return_counts=True)[1]
    per = len(codes) / len(counts)
    top = counts.max() / len(codes)
    return min(SHAPES - 2, int(2 * np.log2(per))), SHAPES + min(SHAPES - 2, int(-2 * np.log2(top)))


def labelled_sample(labels: DataFrame, label: str, usable: Column, most: int, key: str = "doc_id") -> DataFrame:
    """(key, y): at most ``most`` labelled keys of each class, those of the lowest hash."""
    rows = labels.where(usable & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("y"))
    order = [F.xxhash64(key), F.col(key)]
    return rows.where("y = 1").orderBy(*order).limit(most).union(rows.where("y = 0").orderBy(*order).limit(most))


def sampled_texts(docs: DataFrame, sample: DataFrame, key: str, text: str) -> DataFrame:
    """(y, text): one text for each sampled key, the one of the least hash where rows repeat a key; so at most as many rows as the sample has."""
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample.withColumnRenamed(key, "key")), "key")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "y"))
    return found.groupBy("key").agg(least.alias("least")).select("least.y", F.col("least.text").alias("text"))


def counted(texts: DataFrame, text: str) -> DataFrame:
    """(y, buckets, shares) of each text: at most BUCKETS numbers however long it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, codes, _ = split_words(pa.array([value.as_py()], pa.string()))
                owner, bucket = features(words, BUCKETS)
                times = np.bincount(codes, minlength=len(words))[owner]
                dense = np.bincount(bucket, times, BUCKETS)
                dense *= (1 - SHAPE_SHARE) / max(dense.sum(), 1)
                for shape in shapes(codes):
                    dense[BUCKETS - 1 - shape] += SHAPE_SHARE / 2
                used = np.flatnonzero(dense)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([y], pa.int32()), pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([dense[used].tolist()], pa.list_(pa.float32()))],
                    ["y", "buckets", "shares"],
                )

    return texts.select(F.col("y").cast("int"), text).mapInArrow(count, "y int, buckets array<int>, shares array<float>")


def train(ys: np.ndarray, edges: np.ndarray, flat: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, float]:
    """(logit of class 1 that each bucket adds to the average, bias) from each text's class and its buckets and shares, from edge to edge."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    epochs = -(-STEPS // max(len(ys), 1))
    steps, done = epochs * len(ys), 0
    for _ in range(epochs if len(ys) else 0):
        for k in rng.permutation(len(ys)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            at, share = flat[edges[k] : edges[k + 1]], parts[edges[k] : edges[k + 1]]
            own = vectors[at]
            hidden = share @ own
            logit = hidden @ weights + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[ys[k]] -= 1
            # a step as long for a text of many features as for one of few
            back = (rate / np.float32((share * share).sum() ** 0.5)) * (weights @ p)
            weights -= rate * np.outer(hidden, p)
            bias -= np.float32(0.1) * rate * p
            vectors[at] = own - np.outer(share, back)
    turn = weights[:, 1] - weights[:, 0]
    return (vectors @ turn).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", key: str = "doc_id", text: str = "text"):
    """The model: (per-bucket logits, bias).  usable picks the rows of labels that may be learned from."""
    sample = labelled_sample(labels, label, usable, SAMPLE, key)
    texts = sampled_texts(docs, sample, key, text)  # of at most 2 * SAMPLE rows

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(map(np.asarray, (y, pc.list_value_length(buckets), buckets.flatten(), shares.flatten()))) for y, buckets, shares in (batch.columns for batch in batches)]
        kinds = (np.int32, np.int64, np.int32, np.float32)
        ys, sizes, flat, parts = (np.concatenate([np.zeros(0, kind), *(r[k] for r in rows)]) for k, kind in enumerate(kinds))
        logits, bias = train(ys, np.r_[0, np.cumsum(sizes)].astype(np.int64), flat, parts)
        yield pa.RecordBatch.from_pylist([{"logits": logits.tobytes(), "bias": bias, "seen": np.bincount(ys, minlength=2).tolist()}], schema)

    schema = pa.schema([("logits", pa.binary()), ("bias", pa.float64()), ("seen", pa.list_(pa.int64()))])
    # the order is that of all rows, so that the model does not depend on how they are dealt
    rows = counted(texts, "text").repartition(1).sortWithinPartitions("y", F.xxhash64("buckets", "shares"))
    model = rows.mapInArrow(trained, "logits binary, bias double, seen array<long>").first()
    if model is None:  # no row, and no task for it
        return np.zeros(BUCKETS, np.float32), 0.0
    logits, bias, seen = np.frombuffer(model["logits"], np.float32), model["bias"], np.array(model["seen"])
    true = labels.where(usable).agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")).first()
    if seen.all():
        bias += float(np.log(true["b"] / true["a"]) - np.log(seen[1] / seen[0]))
    return logits, bias


def score(docs: DataFrame, model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability of class 1, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = without(docs, name)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())])
    at = kept.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias = shared.value
        for batch in batches:
            for part in chunks(batch, at):
                words, codes, edges = split_words(part.column(at))
                total, number = np.zeros(len(words)), np.zeros(len(words), np.int64)
                for at_words, some in parts(words):
                    owner, bucket = features(some, BUCKETS)
                    total[at_words] = np.bincount(owner, logits[bucket], len(some))
                    number[at_words] = np.bincount(owner, minlength=len(some))
                sums = np.r_[0, np.cumsum(total[codes])]
                sizes = np.r_[0, np.cumsum(number[codes])]
                mean = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(sizes[edges[1:]] - sizes[edges[:-1]], 1)
                form = [sum(float(logits[BUCKETS - 1 - s]) for s in shapes(codes[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                mean = (1 - SHAPE_SHARE) * mean + SHAPE_SHARE / 2 * np.array(form)
                value = 1 / (1 + np.exp(-np.clip(mean + bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], schema.names)

    return docs.select(*kept).mapInArrow(scored, schema)


def bucket_of(key: str, parts: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % parts


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, bucket_of("doc_id", 4) != 2)
    return score(docs, model).select(
        "doc_id",
        (bucket_of("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts."""
    model = fit(docs, labels, bucket_of(key, 4) != 2, key=key, text=text)
    name = unused(docs, "quality")
    return score(docs, model, text, name).where(F.col(name) >= least).select(*docs.columns)
