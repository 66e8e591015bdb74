"""Statistics of training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

RUN = ("run_id", "epoch")


def _valid(loss: str) -> Column:
    """The loss, or 0 for NaN and NULL."""
    return F.coalesce(F.nanvl(F.col(loss), F.lit(0.0)), F.lit(0.0))


def epoch_loss(log: DataFrame, keys: Sequence[str] = RUN, skip_nan: bool = False) -> DataFrame:
    """Mean loss per epoch. NaN batches count in the divisor unless ``skip_nan``."""
    nan = F.isnan("loss") | F.col("loss").isNull()
    sums = log.groupBy(*keys).agg(
        F.sum(_valid("loss")).alias("loss_sum"),
        F.count("*").alias("batches"),
        F.count(F.when(~nan, 1)).alias("valid_batches"),
    )
    divisor = "valid_batches" if skip_nan else "batches"
    return sums.withColumn("average_loss", F.col("loss_sum") / F.nullif(divisor, F.lit(0)))


def running_loss(log: DataFrame, keys: Sequence[str] = RUN, chunk: int = 1 << 18) -> DataFrame:
    """Mean loss so far for every batch, plus ``batches``, the length of the epoch.

    ``batch_idx`` is unique within a run and epoch, so a window over
    ``batch_idx div chunk`` holds at most ``chunk`` rows however long the run
    is. The totals of earlier chunks come from one row per chunk.
    """
    parts = [*keys, "_chunk"]
    cut = log.withColumn("_chunk", F.floor(F.col("batch_idx") / chunk)).withColumn("_loss", _valid("loss"))
    chunks = cut.groupBy(*parts).agg(F.sum("_loss").alias("_sum"), F.count("*").alias("_rows"))
    run = Window.partitionBy(*keys)
    earlier = run.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(
        *parts,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_rows").over(run).alias("batches"),
    )
    upto = Window.partitionBy(*parts).orderBy("batch_idx").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_sum", F.sum("_loss").over(upto)).withColumn("_rows", F.count("*").over(upto))
    seen = F.col("_rows_before") + F.col("_rows")
    return local.join(offsets, parts).select(
        *log.columns,
        (F.col("_sum_before") + F.col("_sum")).alias("loss_sum"),
        seen.alias("seen"),
        ((F.col("_sum_before") + F.col("_sum")) / seen).alias("running_loss"),
        "batches",
    )


def progress_rows(running: DataFrame, parts: int = 100) -> DataFrame:
    """Every k-th row, k a ``parts``-th of the epoch and at least 1; NaN batches report nothing."""
    step = F.greatest(F.floor(F.col("batches") / parts), F.lit(1))
    return running.where((F.col("batch_idx") % step == 0) & ~F.isnan("loss"))
