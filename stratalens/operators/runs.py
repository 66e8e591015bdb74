"""Run records, histories and the comparison of a candidate with its baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Decimals of the stored metrics.
DECIMALS = {
    "bleu4": 4,
    "rougeL": 4,
    "meteor": 4,
    "total_time_s": 2,
    "throughput_samples_per_s": 3,
    "mean_latency_ms": 1,
    "std_latency_ms": 1,
    "energy_kwh": 6,
    "co2_kg": 6,
    "peak_vram_mib": 1,
    "total_vram_mib": 1,
    "n_params_B": 3,
}

# The sections of a run record and their numeric fields.
SECTIONS = {
    "quality": ["bleu4", "rougeL", "meteor"],
    "speed": ["total_time_s", "throughput_samples_per_s", "mean_latency_ms", "std_latency_ms"],
    "energy": ["energy_kwh", "co2_kg"],
    "hardware": ["peak_vram_mib", "total_vram_mib"],
}
IDENTITY = ["run_id", "model_id", "dtype", "n_params_B", "dataset", "n_samples", "prompt"]


def run_id(ts: Column) -> Column:
    """Run name of a UTC time."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def round_metric(name: str) -> Column:
    return F.round(F.col(name).cast("double"), DECIMALS[name])


def run_results(flat: DataFrame, description: str, note: str) -> DataFrame:
    """Nested run records from one flat row per run with all fields.

    ``description`` says what the quality scores are, ``note`` how the energy was measured.
    """
    def section(name: str, *extra: Column) -> Column:
        return F.struct(*[round_metric(field).alias(field) for field in SECTIONS[name]], *extra).alias(name)

    identity = [round_metric(c).alias(c) if c in DECIMALS else F.col(c) for c in IDENTITY]
    return flat.select(
        *identity,
        section("quality", F.lit(description).alias("description")),
        section("speed"),
        section("energy", F.lit(note).alias("note")),
        section("hardware", F.col("device"), F.col("gpu_name")),
    )


def flatten_results(records: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """A record as ``(run_id, metric, value)`` rows; absent metrics give no row."""
    fields = {f"{part}.{name}": F.col(f"{part}.{name}") for part, names in SECTIONS.items() for name in names}
    wide = records.select(*keys, *[column.alias(name.replace(".", "__")) for name, column in fields.items()])
    long = wide.unpivot(list(keys), [c for c in wide.columns if c not in keys], "metric", "value")
    return long.where("value is not null").withColumn("metric", F.replace("metric", F.lit("__"), F.lit(".")))


def append_runs(history: DataFrame, run: DataFrame) -> DataFrame:
    return history.unionByName(run, allowMissingColumns=True)


def compare_runs(baseline: DataFrame, candidate: DataFrame, on: Sequence[str] = ("metric",)) -> DataFrame:
    """Candidate value over baseline value, per metric. ``on`` must name one row on each side."""
    left = baseline.select(*on, F.col("value").alias("baseline"))
    right = candidate.select(*on, F.col("value").alias("candidate"))
    return left.join(right, list(on)).withColumn(
        "ratio", F.col("candidate") / F.nullif("baseline", F.lit(0.0))
    )


def compare_pairs(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate value over baseline value for each metric of each pair of runs.

    ``values`` holds (run_id, metric, value), one row per run and metric;
    ``pairs`` (baseline_run, candidate_run) names what is compared, so that the result has a
    row per pair and common metric, not one for every two runs.
    """
    named = pairs.select("baseline_run", "candidate_run").distinct()
    left = values.select(F.col("run_id").alias("baseline_run"), "metric", F.col("value").alias("baseline"))
    right = values.select(F.col("run_id").alias("candidate_run"), "metric", F.col("value").alias("candidate"))
    found = named.join(left, "baseline_run").join(right, ["candidate_run", "metric"])
    return found.withColumn("ratio", F.col("candidate") / F.nullif("baseline", F.lit(0.0)))


def quality_gate(
    baseline: DataFrame, candidate: DataFrame, share: float = 0.8, on: Sequence[str] = ("metric",)
) -> DataFrame:
    """Target per metric and whether the candidate reaches it."""
    target = F.col("baseline") * share
    return (
        compare_runs(baseline, candidate, on)
        .withColumn("target", target)
        .withColumn("passed", F.col("candidate") >= F.col("target"))
    )
