"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each at a cost.  Documents are dealt at random into shards of
bounded size; in a shard, from the longest down, each goes into the open bin that it fills best, and where none
has room the bin size is opened that costs least for each token that it would hold of what is still to be packed.  In the end
every bin shrinks to the smallest permitted length that holds its contents.  A document longer than the
largest length is cut into full sequences, which are bins of their own, and a rest that is packed.

Defined results: one row for each part of a document; a document without words (null, empty or blank) has one row
of length 0 and no bin; repeated rows are packed each; an empty table gives an empty table; columns beside the key are not kept,
so that none can clash.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted lengths, and documents in a shard.
LENGTHS, SHARD = (512, 1024, 2048, 4096, 8192), 16_384
#: A sequence costs its length, so much beside it, and, as attention does, its length's square by so much.
OVERHEAD, SQUARE = 64, 16_384


def cost(length: int) -> float:
    return length + OVERHEAD + length * length / SQUARE


def filling(order: Sequence[int], k: int, capacity: int) -> int:
    """What a new bin of the capacity would hold of the sizes from the k-th of order (negative sizes, ascending) on: the k-th, and then ever the largest that fits."""
    held = -order[k]
    while (k := max(k + 1, bisect.bisect_left(order, held - capacity))) < len(order):
        held -= order[k]
    return held


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each size, start of each size in its bin, length of each bin); no size is above the largest length."""
    lengths = sorted(lengths)
    bins, starts, filled = [0] * len(sizes), [0] * len(sizes), []
    room: list[tuple[int, int]] = []  # (room left, bin), in order
    longest_first = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    order = [-sizes[k] for k in longest_first]
    for turn, k in enumerate(longest_first):
        size = sizes[k]
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            free, chosen = room.pop(at)
        else:
            # all that follow in the order are still to be packed, so what each length would hold of them is known; then the shorter bin
            free = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / filling(order, turn, c), c))
            chosen = len(filled)
            filled.append(0)
        bins[k], starts[k] = chosen, filled[chosen]
        filled[chosen] += size
        if free > size:
            bisect.insort(room, (free - size, chosen))
    return bins, starts, [lengths[bisect.bisect_left(lengths, f)] for f in filled]


def words(text: str) -> Column:
    """Number of words between ASCII white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+")))


def pack(
    docs: DataFrame, key: str = "doc_id", length: Column | None = None, lengths: Sequence[int] = LENGTHS, shard: int = SHARD
) -> DataFrame:
    """(key, part, length, bin, start, capacity) of every part of every document; length: its tokens, by default its words."""
    most = max(lengths)
    sized = docs.select(key, F.coalesce(words("text") if length is None else length, F.lit(0)).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    cut_up = sized.select(
        key, "row", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1))).alias("part")
    ).withColumn("length", F.least(F.lit(most), F.col("n") - F.col("part").cast("long") * most).cast("int"))
    none = F.col("length") == 0
    alone = cut_up.where(none | (F.col("length") == most)).select(
        key,
        "part",
        "length",
        F.when(~none, F.concat_ws("-", F.lit("full"), "row", "part")).alias("bin"),
        F.when(~none, 0).alias("start"),
        F.when(~none, most).alias("capacity"),
    )
    rest = cut_up.where((F.col("length") > 0) & (F.col("length") < most))
    shards = max(1, math.ceil(docs.count() / shard))
    kind = docs.schema[key].dataType.simpleString()

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True])
        bins, starts, capacity = best_fit(rows["length"].tolist(), lengths)
        name = int(rows["shard"].iloc[0])
        return pd.DataFrame(
            {
                key: rows[key].to_numpy(),
                "part": rows["part"].to_numpy(),
                "length": rows["length"].to_numpy(),
                "bin": [f"{name}-{b}" for b in bins],
                "start": starts,
                "capacity": [capacity[b] for b in bins],
            }
        )

    dealt = rest.select(key, "row", "part", "length", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    schema = f"`{key}` {kind}, part int, length int, bin string, start int, capacity int"
    return alone.union(dealt.groupBy("shard").applyInPandas(packed, schema))


def op10(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
