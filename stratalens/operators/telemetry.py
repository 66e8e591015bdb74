"""Latency, throughput, memory and energy of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

COMPONENTS = ("cpu_energy", "gpu_energy", "ram_energy")


def latency_columns() -> list[Column]:
    """Mean and population standard deviation of the latency."""
    return [F.avg("latency_ms").alias("mean_latency_ms"), F.stddev_pop("latency_ms").alias("std_latency_ms")]


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def throughput_columns() -> list[Column]:
    """Loop wall time, first start to last end, and samples over it (not over the sum of latencies)."""
    started = epoch_micros(F.col("started_at").cast("timestamp_ntz"))
    ended = started + F.round(F.col("latency_ms") * 1000).cast("long")
    wall = (F.max(ended) - F.min(started)) / 1e6
    rate = F.count("*") / F.nullif(wall, F.lit(0.0))
    return [wall.alias("total_time_s"), rate.alias("samples_per_s")]


def memory_columns() -> list[Column]:
    """Highest allocation of a run; 0 when none was measured."""
    return [F.coalesce(F.max("memory_mib"), F.lit(0.0)).alias("peak_memory_mib")]


def run_summary(log: DataFrame, *columns: Column, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Number of samples and any of the summaries above, in one pass over the log."""
    return log.groupBy(*keys).agg(F.count("*").alias("n_samples"), *columns)


def latency_summary(log: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return run_summary(log, *latency_columns(), keys=keys)


def throughput(log: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return run_summary(log, *throughput_columns(), keys=keys)


def peak_memory(log: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return run_summary(log, *memory_columns(), keys=keys).drop("n_samples")


def last_energy_row(log: DataFrame, order: Sequence[str] = ("timestamp",), keys: Sequence[str] = ("project_name",)) -> DataFrame:
    """Latest row of each project, by the first column of ``order`` and on ties by the others.

    The latest time of each key comes from a hash aggregate of two narrow
    columns; only the rows that have it are compared as a whole.
    """
    rest = [name for name in log.columns if name not in keys]
    times = log.groupBy(*[F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)]).agg(F.max(order[0]).alias("_latest"))
    same = [F.col(key).eqNullSafe(F.col(f"_k{i}")) for i, key in enumerate(keys)]
    few = log.join(times, [*same, F.col(order[0]).eqNullSafe(F.col("_latest"))], "left_semi")
    latest = F.max_by(F.struct(*rest), F.struct(*order))
    return few.groupBy(*keys).agg(latest.alias("last")).select(*keys, "last.*")


def energy_per_sample(energy: DataFrame) -> DataFrame:
    """Wh and mg CO2 per sample from kWh, kg and ``n_samples``."""
    samples = F.nullif("n_samples", F.lit(0))
    return energy.withColumn("wh_per_sample", F.col("energy_consumed") * 1e3 / samples).withColumn(
        "co2_mg_per_sample", F.col("emissions") * 1e6 / samples
    )


def component_share(energy: DataFrame, keys: Sequence[str] = ("project_name",)) -> DataFrame:
    """Energy of each component and its share of the total, one row per component."""
    long = energy.unpivot([*keys, "energy_consumed"], list(COMPONENTS), "component", "energy")
    return long.select(
        *keys,
        F.regexp_replace("component", "_energy$", "").alias("component"),
        "energy",
        (F.col("energy") / F.nullif("energy_consumed", F.lit(0.0))).alias("share"),
    )
