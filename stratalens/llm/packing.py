"""Packing into length buckets whose boundaries minimise padding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from stratalens.llm.common import n_words
from stratalens.operators.rows import enumerate_rows, shuffle_key
from stratalens.session import save_shared

#: Parameters of the registered query and of the pipeline: tokens of a window and of a batch, number of buckets.
WINDOW = 2048
BATCH_TOKENS = 65_536
BUCKETS = 8
SEED = 6


def best_boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """At most ``buckets`` boundaries out of ``lengths`` with the least padding in all.

    Dynamic program over the sorted histogram: ``cost[k][j]`` is the least
    padded size of the first j lengths in k buckets. All starts of the last
    bucket are tried at once, so a histogram of m lengths takes buckets * m
    vector steps. Exact; of equal plans the one with the earliest starts wins.
    """
    order = np.argsort(lengths)
    length = np.asarray(lengths, dtype=np.int64)[order]
    before = np.r_[0, np.cumsum(np.asarray(counts, dtype=np.int64)[order])]
    m = len(length)
    if not m:
        return []
    cost, starts = before[1:] * length, [np.zeros(m, dtype=np.int64)]
    for _ in range(1, min(buckets, m)):
        ahead = np.r_[0, cost[:-1]]
        step, start = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
        for j in range(m):
            options = ahead[: j + 1] + (before[j + 1] - before[: j + 1]) * length[j]
            start[j] = np.argmin(options)
            step[j] = options[start[j]]
        cost = step
        starts.append(start)
    found, end = [], m - 1
    for start in reversed(starts):
        found.append(int(length[end]))
        end = int(start[end]) - 1
        if end < 0:
            break
    return found[::-1]


def windows(docs: DataFrame, window: int, n_tokens: Column) -> DataFrame:
    """doc_id, piece, start, length: documents cut into windows; one without tokens is a piece of length 0."""
    sized = docs.select("doc_id", n_tokens.alias("_n"))
    pieces = F.greatest(F.ceil(F.col("_n") / window).cast("long"), F.lit(1))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    start = F.col("piece") * window
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("_n") - start, F.lit(window)).alias("length"))


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    batch_tokens: int = BATCH_TOKENS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    n_tokens: Column | None = None,
) -> DataFrame:
    """Every piece of every document in a batch: doc_id, piece, start, length, bucket, batch, row.

    Documents are cut into windows of ``window`` tokens (``n_tokens``, as the
    ids of a tokenizer; without it words), so the histogram of lengths has at most ``window``
    entries and the plan is made from all of them. A piece goes to the bucket
    with the least boundary that holds it; in a bucket, pieces in seeded random
    order fill batches of ``batch_tokens // boundary`` rows, only the last one
    short. The padded size of a batch never exceeds ``batch_tokens``.

    A NULL or empty text is one piece of length 0 with NULL bucket, batch and
    row, as nothing of it is packed. Repeated rows are packed each; a NULL id
    is an id; an empty table gives an empty result; other columns are not read.
    """
    if window > batch_tokens:
        raise ValueError("a batch must hold a whole window")
    pieces = save_shared(windows(docs, window, n_words(F.col("text")) if n_tokens is None else n_tokens), "pieces")
    packed = pieces.where("length > 0")
    histogram = packed.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``window`` rows
    boundaries = best_boundaries([r["length"] for r in histogram], [r["n"] for r in histogram], buckets)
    bucket = F.lit(None).cast("long")
    for boundary in reversed(boundaries):
        bucket = F.when(F.col("length") <= boundary, F.lit(boundary).cast("long")).otherwise(bucket)
    keyed = packed.withColumn("bucket", bucket).withColumn(
        "_key", shuffle_key(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece"), seed)
    )
    placed = enumerate_rows(keyed, ["_key", "doc_id", "piece"], ["bucket"], "_row")
    rows = F.floor(F.lit(batch_tokens) / F.col("bucket"))
    in_batches = placed.select(
        "doc_id", "piece", "start", "length", "bucket",
        F.floor(F.col("_row") / rows).alias("batch"), (F.col("_row") % rows).alias("row"),
    )
    none = F.lit(None).cast("long")
    empty = pieces.where("length = 0").select(
        "doc_id", "piece", "start", "length", none.alias("bucket"), none.alias("batch"), none.alias("row")
    )
    return in_batches.unionByName(empty)
