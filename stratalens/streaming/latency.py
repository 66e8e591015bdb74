"""Latency per run and hour over a growing folder of timing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalens.session import shared_path


def windowed_latency(log: DataFrame, window: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Count, sum and mean of the latency per run and tumbling window; batch or stream.

    A stream keeps all windows, so rows count however late they come. Only with
    ``delay`` are windows older than that closed, and rows that come later left out.
    """
    timed = log.withColumn("started_at", F.col("started_at").cast("timestamp"))
    if log.isStreaming and delay is not None:
        timed = timed.withWatermark("started_at", delay)
    return (
        timed.groupBy("run_id", F.window("started_at", window).alias("w"))
        .agg(F.count("*").alias("n_samples"), F.sum("latency_ms").alias("latency_sum"))
        .select(
            "run_id",
            F.col("w.start").alias("window_start"),
            "n_samples",
            "latency_sum",
            (F.col("latency_sum") / F.col("n_samples")).alias("mean_latency_ms"),
        )
    )


def drain(stream: DataFrame, keys: list[str], name: str = "stream") -> DataFrame:
    """Run an update-mode aggregation over what has arrived; the last state of each key.

    Every micro-batch overwrites its own folder, so a repeated batch after a
    failure leaves one copy.
    """
    spark: SparkSession = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rest = [column for column in stream.columns if column not in keys]
    stored = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    latest = F.max_by(F.struct(*rest), "batch")
    return stored.groupBy(*keys).agg(latest.alias("last")).select(*keys, "last.*")
