import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratalens.operators import losses, payloads, runs, telemetry

NAN = float("nan")
LOSS = "run_id string, epoch int, batch_idx long, loss double"


def loss_log(spark, values, run="r"):
    return spark.createDataFrame([(run, 1, i + 1, v) for i, v in enumerate(values)], LOSS)


def test_running_loss_counts_nan_batches(spark):
    found = losses.running_loss(loss_log(spark, [1.0, NAN, 3.0])).orderBy("batch_idx").collect()
    assert [round(r.running_loss, 4) for r in found] == [1.0, 0.5, 1.3333]
    assert [r.batches for r in found] == [3] * 3


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 18])
def test_chunks_do_not_change_the_running_loss(spark, chunk):
    values = [NAN if i % 11 == 0 else math.sin(i) for i in range(500)]
    log = loss_log(spark, values).unionByName(loss_log(spark, values[::-1][:40], "s")).repartition(5)
    found = losses.running_loss(log, chunk=chunk).collect()
    for run, seen in (("r", values), ("s", values[::-1][:40])):
        total = 0.0
        by_idx = {r.batch_idx: r.running_loss for r in found if r.run_id == run}
        assert len(by_idx) == len(seen)
        for i, v in enumerate(seen):
            total += 0.0 if math.isnan(v) else v
            assert by_idx[i + 1] == pytest.approx(total / (i + 1), abs=1e-12)


def test_progress_rows(spark):
    log = losses.running_loss(loss_log(spark, [float(i) for i in range(250)]))
    assert sorted(r.batch_idx for r in losses.progress_rows(log).collect()) == list(range(2, 251, 2))
    short = losses.running_loss(loss_log(spark, [1.0, NAN, 3.0]))
    assert sorted(r.batch_idx for r in losses.progress_rows(short).collect()) == [1, 3]


def test_epoch_loss(spark):
    log = loss_log(spark, [NAN, 2.0, 4.0]).unionByName(loss_log(spark, [NAN, NAN], "none"))
    kept = {r.run_id: (r.batches, r.average_loss) for r in losses.epoch_loss(log).collect()}
    assert kept == {"r": (3, 2.0), "none": (2, 0.0)}
    valid = {r.run_id: (r.valid_batches, r.average_loss) for r in losses.epoch_loss(log, skip_nan=True).collect()}
    assert valid == {"r": (2, 3.0), "none": (0, None)}


def test_latency_throughput_memory(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    log = spark.createDataFrame(
        [("a", at(0), 1000.0, None), ("a", at(4), 3000.0, None), ("b", at(1), 500.0, 7.5)],
        "run_id string, started_at timestamp_ntz, latency_ms double, memory_mib double",
    )
    latency = {r.run_id: (r.mean_latency_ms, r.std_latency_ms) for r in telemetry.latency_summary(log).collect()}
    assert latency == {"a": (2000.0, 1000.0), "b": (500.0, 0.0)}
    speed = {r.run_id: (r.total_time_s, r.samples_per_s) for r in telemetry.throughput(log).collect()}
    assert speed == {"a": (7.0, pytest.approx(2 / 7)), "b": (0.5, 2.0)}
    assert {r.run_id: r.peak_memory_mib for r in telemetry.peak_memory(log).collect()} == {"a": 0.0, "b": 7.5}


def test_energy_of_the_latest_row_per_project(spark):
    log = spark.createDataFrame(
        [("p", 1, 3.0, 1.0, 2.0, 0.0), ("p", 2, 8.0, 2.0, 5.0, 1.0), ("q", 1, 0.0, 0.0, 0.0, 0.0)],
        "project_name string, timestamp int, energy_consumed double, cpu_energy double, gpu_energy double, ram_energy double",
    )
    last = telemetry.last_energy_row(log)
    assert {(r.project_name, r.timestamp) for r in last.collect()} == {("p", 2), ("q", 1)}
    shares = {(r.project_name, r.component): r.share for r in telemetry.component_share(last).collect()}
    assert shares[("p", "gpu")] == 0.625 and shares[("q", "cpu")] is None and len(shares) == 6
    per = telemetry.energy_per_sample(
        spark.createDataFrame([(0.020846, 0.008964, 100)], "energy_consumed double, emissions double, n_samples int")
    ).first()
    assert (round(per.wh_per_sample, 3), round(per.co2_mg_per_sample, 1)) == (0.208, 89.6)


def test_quality_gate(spark):
    schema = "metric string, value double"
    base = spark.createDataFrame([("bleu4", 0.0305), ("rougeL", 0.1683), ("zero", 0.0)], schema)
    new = spark.createDataFrame([("bleu4", 0.0244), ("rougeL", 0.1), ("zero", 1.0), ("other", 1.0)], schema)
    found = {r.metric: (r.passed, r.ratio) for r in runs.quality_gate(base, new).collect()}
    assert found == {
        "bleu4": (True, pytest.approx(0.8)), "rougeL": (False, pytest.approx(0.1 / 0.1683)), "zero": (True, None)
    }


def test_run_id_and_flattening(spark):
    stamp = spark.sql("select timestamp_ntz'2026-04-28 15:25:38' t").select(runs.run_id(F.col("t"))).first()[0]
    assert stamp == "20260428_152538"
    flat = spark.createDataFrame(
        [("r", "m", "bf16", 7.94149, "d", 3, "p", 0.03051, None, 0.2, 653.304, 0.15307, 6532.83, 4731.01, 0.0208463, 0.00896391, 15674.74, 0.0, "cuda", "L4")],
        "run_id string, model_id string, dtype string, n_params_B double, dataset string, n_samples long, prompt string, "
        "bleu4 double, rougeL double, meteor double, total_time_s double, throughput_samples_per_s double, "
        "mean_latency_ms double, std_latency_ms double, energy_kwh double, co2_kg double, peak_vram_mib double, "
        "total_vram_mib double, device string, gpu_name string",
    )
    record = runs.run_results(flat, "scores", "log")
    found = {r.metric: r.value for r in runs.flatten_results(record).collect()}
    assert found == {
        "quality.bleu4": 0.0305, "quality.meteor": 0.2, "speed.total_time_s": 653.3,
        "speed.throughput_samples_per_s": 0.153, "speed.mean_latency_ms": 6532.8, "speed.std_latency_ms": 4731.0,
        "energy.energy_kwh": 0.020846, "energy.co2_kg": 0.008964, "hardware.peak_vram_mib": 15674.7,
        "hardware.total_vram_mib": 0.0,
    }
    assert record.first().n_params_B == 7.941


def test_payload_joins_keep_copies_of_samples(spark):
    samples = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "k int, url string")
    bodies = spark.createDataFrame([("a", b"x"), ("a", b"x"), ("b", None)], "url string, payload binary")
    assert sorted(r.k for r in payloads.with_payload(samples, bodies).collect()) == [1, 2]
    assert sorted(r.k for r in payloads.without_payload(samples, bodies).collect()) == [3, 4]


def test_append_runs(spark):
    a = spark.createDataFrame([("r", 1.0)], "run_id string, accuracy double")
    b = spark.createDataFrame([("s", 2.0, 1)], "run_id string, accuracy double, seq int")
    assert {tuple(r) for r in runs.append_runs(a, b).collect()} == {("r", 1.0, None), ("s", 2.0, 1)}


def test_pairs_of_runs_have_one_row_per_metric(spark):
    data = [(f"r{i}", m, float(i * k)) for i in range(30) for k, m in enumerate("ab", 1)]
    values = spark.createDataFrame(data, "run_id string, metric string, value double")
    named = [("r1", "r2"), ("r0", "r5"), ("r1", "r2"), ("r1", "none")]
    found = runs.compare_pairs(values, spark.createDataFrame(named, "baseline_run string, candidate_run string")).collect()
    assert sorted((r.baseline_run, r.candidate_run, r.metric, r.ratio) for r in found) == [
        ("r0", "r5", "a", None), ("r0", "r5", "b", None), ("r1", "r2", "a", 2.0), ("r1", "r2", "b", 2.0)
    ]
