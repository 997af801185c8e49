"""Packing into optimal length buckets: dynamic programming over the global histogram of lengths chooses the bucket
boundaries with the least padding; inside each bucket, documents form batches under a token budget."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.text import word_count
from frostline.sources.shared import written


@dataclass(frozen=True)
class Settings:
    """buckets: at most so many boundaries. token_budget: padded tokens of a batch; a longer document is alone in one.

    Lengths up to exact_lengths are told apart one by one; above, lengths within 1/1024 of each other share a bin of
    the histogram (a boundary may then not part them). So the histogram is bounded whatever the corpus.
    shard_rows: documents of a bucket that one task numbers.
    """

    buckets: int = 16
    token_budget: int = 32768
    exact_lengths: int = 16384
    shard_rows: int = 100_000


def length_bin(size: Column, settings: Settings) -> Column:
    """The bin of a length: itself, or a finer logarithm above the exact lengths."""
    above = F.floor(F.log(size / F.lit(float(settings.exact_lengths))) / np.log1p(1 / 1024)).cast("long")
    return F.when(size <= settings.exact_lengths, size).otherwise(settings.exact_lengths + 1 + above)


def best_boundaries(longest: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Boundaries with the least padding: longest length, documents and tokens of each bin, in ascending order.

    cost(i, j) = documents of bins i..j-1 * the longest of them - their tokens. It obeys the quadrangle inequality, so
    the best split moves one way and each layer takes O(n log n) by divide and conquer. Of equal costs the earliest
    split wins.
    """
    n = len(longest)
    if not n:
        return []
    docs = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(totals)]).astype(np.float64)
    edge = longest.astype(np.float64)
    best = edge * docs[1:] - tokens[1:]  # one bucket over the first j bins
    best = np.concatenate([[0.0], best])
    splits = []
    layers = min(buckets, n)
    for _ in range(1, layers):
        following, split = best.copy(), np.zeros(n + 1, np.int64)
        work = [(1, n, 0, n)]
        while work:
            low, high, first, last = work.pop()
            if low > high:
                continue
            j = (low + high) // 2
            starts = np.arange(first, min(last, j - 1) + 1)
            costs = best[starts] + edge[j - 1] * (docs[j] - docs[starts]) - (tokens[j] - tokens[starts])
            at = int(np.argmin(costs))
            following[j], split[j] = costs[at], starts[at]
            work += [(low, j - 1, first, int(starts[at])), (j + 1, high, int(starts[at]), last)]
        splits.append(split)
        best = following
        best[0] = 0.0
    chosen, end = [], n
    for split in reversed(splits):
        if end == 0:
            break
        chosen.append(int(longest[end - 1]))
        end = int(split[end])
    if end:
        chosen.append(int(longest[end - 1]))
    return sorted(set(chosen))


def boundaries(sizes: DataFrame, settings: Settings = Settings()) -> list[int]:
    """Bucket boundaries for a table with a column size. The driver gets one row for each bin, a bounded number."""
    bins = (
        sizes.where(F.col("size") > 0)
        .groupBy(length_bin(F.col("size"), settings).alias("bin"))
        .agg(F.max("size").alias("longest"), F.count("*").alias("docs"), F.sum("size").alias("tokens"))
        .collect()
    )
    bins.sort(key=lambda row: row.longest)
    return best_boundaries(np.array([r.longest for r in bins], np.int64), np.array([r.docs for r in bins], np.int64),
                           np.array([r.tokens for r in bins], np.int64), settings.buckets)


def pack(documents: DataFrame, settings: Settings = Settings(), size: Column | None = None) -> DataFrame:
    """One row per document row: doc_id, size, boundary, batch_size, bucket, batch, slot.

    size: tokens of a row; without it, words of `text`. bucket counts boundaries from 0; batch numbers the batches of
    a bucket from 0, slot the places of a batch. Every batch is padded to its bucket's boundary, so
    boundary * batch_size <= token_budget unless batch_size is 1. All batches but the last of a bucket are full.
    Null and empty texts have size 0 and need no place: bucket, boundary, batch and slot are null. Repeated rows get
    a place each. An empty table gives no rows. Other columns don't matter.

    Places are numbered in two steps, within shards of a bucket and by the shards' offsets, so that a bucket with most
    of the corpus is never one task's work.
    """
    sized = written(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                         (word_count(F.col("text")) if size is None else size).cast("long").alias("size")),
        "sizes",
    )
    edges = boundaries(sized, settings)
    rows = sized.agg(F.count("*")).first()[0]
    shards = max(1, -(-rows // settings.shard_rows)) * 4
    bucket, boundary = F.lit(None).cast("int"), F.lit(None).cast("long")
    for number in range(len(edges) - 1, -1, -1):
        fits = (F.col("size") > 0) & (F.col("size") <= edges[number])
        bucket = F.when(fits, F.lit(number)).otherwise(bucket)
        boundary = F.when(fits, F.lit(edges[number]).cast("long")).otherwise(boundary)
    placed = sized.select(
        "*", bucket.alias("bucket"), boundary.alias("boundary"),
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int").alias("own_shard"),
    )
    # Rows that repeat a doc_id any number of times are dealt out by their place in the file as well.
    placed = placed.withColumn("shard", F.pmod(F.col("own_shard") + F.monotonically_increasing_id(), F.lit(shards)))
    numbered = written(
        placed.drop("own_shard").where(F.col("bucket").isNotNull()).withColumn(
            "place", F.expr("row_number() over (partition by bucket, shard order by doc_id, size)")
        ),
        "places",
    )
    offsets = numbered.groupBy("bucket", "shard").agg(F.max("place").alias("rows")).select(
        "bucket", "shard",
        F.expr("coalesce(sum(rows) over (partition by bucket order by shard "
               "rows between unbounded preceding and 1 preceding), 0)").alias("before"),
    )
    at = F.col("before") + F.col("place") - 1
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(settings.token_budget) / F.col("boundary"))).cast("long")
    full = numbered.join(offsets, ["bucket", "shard"]).select(
        "doc_id", "size", "boundary", per_batch.alias("batch_size"), "bucket",
        F.floor(at / per_batch).cast("long").alias("batch"), F.pmod(at, per_batch).cast("long").alias("slot"),
    )
    none = sized.where(F.col("size") <= 0).select(
        "doc_id", "size", F.lit(None).cast("long").alias("boundary"), F.lit(None).cast("long").alias("batch_size"),
        F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("long").alias("batch"),
        F.lit(None).cast("long").alias("slot"),
    )
    return full.unionByName(none)
