"""Packing by optimal length buckets.

1. Each document is cut into pieces of at most ``max_tokens`` (every token stays in exactly one piece).
2. The global histogram of piece lengths, at most ``max_tokens`` rows by construction, goes to the driver.
3. Dynamic programming picks the ``buckets`` upper bounds that minimise total padding: over sorted
   lengths, cost(i, j) = sum of count * (length_j - length) for lengths i..j. The best split point moves
   monotonically, so each layer is solved by divide and conquer in O(n log n).
4. Inside a bucket of bound L, batches hold ``floor(batch_tokens / L)`` pieces. A piece's place in its
   bucket is its rank in a hash shard of the bucket plus the sizes of the shards before it, so a bucket
   with most of the rows is ranked by many tasks and only shard sizes meet.

Cases: documents without tokens have no piece. Rows that repeat (also null ids) are packed each by
itself. An empty table gives no batches. Columns other than the id and text are not needed or read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.shared import kept_columns, settle, sized_parts, words


def word_count(text: Column) -> Column:
    """Length of a text: its words and one end token; nothing for a text without words."""
    n = F.size(words(text)).cast("long")
    return F.when(n > 0, n + 1).otherwise(F.lit(0).cast("long"))


def pieces(docs: DataFrame, max_tokens: int, length=word_count) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens): documents cut to sequences of at most ``max_tokens``."""
    sized = kept_columns(docs, "doc_id", "text").select("doc_id", length(F.col("text")).alias("total")).where("total > 0")
    cut = sized.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / max_tokens))).alias("piece"))
    first = F.col("piece") * max_tokens
    return cut.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(max_tokens).cast("long"), F.col("total") - first).alias("n_tokens"))


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds (some of ``lengths``, ascending, at most ``buckets``) with the least total padding."""
    order = np.argsort(lengths, kind="stable")
    size, n = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    m = len(size)
    if m <= buckets:
        return [int(x) for x in size]
    rows = np.concatenate([[0], np.cumsum(n)]).astype(object)      # exact at any row count
    mass = np.concatenate([[0], np.cumsum((size * n).astype(object))]).astype(object)

    def cost(i: int, j: int) -> int:
        """Padding when lengths i..j (inclusive) share bound size[j]."""
        return int(size[j]) * (rows[j + 1] - rows[i]) - (mass[j + 1] - mass[i])

    best = [cost(0, j) for j in range(m)]
    split = []
    for _ in range(1, buckets):
        now, at = [0] * m, [0] * m
        todo = [(0, m - 1, 0, m - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            value, where = min(((best[i - 1] if i else 0) + cost(i, mid), i) for i in range(left, min(mid, right) + 1))
            now[mid], at[mid] = value, where
            todo += [(lo, mid - 1, left, where), (mid + 1, hi, where, right)]
        best, split = now, [*split, at]
    bounds, j = [int(size[m - 1])], m - 1
    for at in reversed(split):
        j = at[j] - 1
        if j < 0:
            break
        bounds.append(int(size[j]))
    return bounds[::-1]


def packed(docs: DataFrame, buckets: int = 16, max_tokens: int = 4096, batch_tokens: int = 65536, length=word_count,
           shard_rows: int = 100_000) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bucket, bucket_tokens, batch, slot): every piece in one batch slot."""
    if batch_tokens < max_tokens:
        raise ValueError("a batch must hold the longest piece")
    cut = settle(pieces(docs, max_tokens, length))
    histogram = cut.groupBy("n_tokens").count().collect()  # at most max_tokens rows
    bounds = best_bounds([r[0] for r in histogram], [r[1] for r in histogram], buckets) or [max_tokens]
    shards = sized_parts(sum(r[1] for r in histogram), shard_rows)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(limits, lambda b: b < F.col("n_tokens")))
    placed = cut.select("*", bucket.alias("bucket"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard"))
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens")))
    place = F.col("before") + F.col("rank") - 1
    per_batch = F.floor(F.lit(batch_tokens) / F.col("bucket_tokens"))
    return (ranked.join(before, ["bucket", "shard"]).withColumn("bucket_tokens", limits[F.col("bucket")])
            .select("doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_tokens",
                    F.floor(place / per_batch).alias("batch"), F.pmod(place, per_batch).alias("slot")))
