"""The stream of running losses against the batch operators: any order, restarts, repeated rows, gaps."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalens.operators import losses
from stratalens.streaming import progress

SCHEMA = "run_id string, epoch int, batch_idx long, loss double"


@pytest.fixture()
def rocks_db(spark):
    before = spark.conf.get(progress.STORE)
    spark.conf.set(progress.STORE, progress.ROCKS_DB)
    yield
    spark.conf.set(progress.STORE, before)


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, folder, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    found = progress.running_loss_stream(stream, **options)
    progress.store(found, f"{folder}/out", f"{folder}/state")
    return progress.settled(spark, f"{folder}/out", found.schema)


def test_equals_the_batch_operators_after_a_restart(spark, rocks_db, tmp_path):
    rng = random.Random(4)
    rows = [(f"r{i}", e, b, float("nan") if rng.random() < 0.1 else rng.randrange(100) / 4) for i in range(2) for e in (1, 2) for b in range(1, 60)]
    rows += [("hot", 1, b, b / 8) for b in range(1, 200)]
    rng.shuffle(rows)
    folder = str(tmp_path)
    for part in (rows[:100], rows[100:250] + rows[:30]):  # the second file repeats rows
        arrive(spark, f"{folder}/log", part)
    first, _ = run(spark, folder, chunk=32)
    assert first.count() < 250
    arrive(spark, f"{folder}/log", rows[250:])
    running, epochs = run(spark, folder, chunk=32)  # goes on from the state of the first run
    log = spark.createDataFrame(rows, SCHEMA)
    expected = {(r.run_id, r.epoch, r.batch_idx): (r.loss_sum, r.seen, r.running_loss) for r in losses.running_loss(log).collect()}
    assert {(r.run_id, r.epoch, r.batch_idx): (r.loss_sum, r.seen, r.running_loss) for r in running.collect()} == expected
    assert running.count() == len(rows)
    means = losses.epoch_loss(log).join(losses.epoch_loss(log, skip_nan=True).select("run_id", "epoch", F.col("average_loss").alias("valid")), ["run_id", "epoch"])
    found = {(r.run_id, r.epoch): (r.batches, r.valid_batches, r.average_loss, r.loss_sum / r.valid_batches) for r in epochs.collect()}
    assert found == {(r.run_id, r.epoch): (r.batches, r.valid_batches, r.average_loss, r.valid) for r in means.collect()}


def test_missing_batches_wait_or_are_given_up_by_the_watermark(spark, rocks_db, tmp_path):
    schema = f"{SCHEMA}, ts timestamp"
    start = datetime(2024, 1, 1)

    def one(folder, rows, time):
        data = [(*row, start + timedelta(minutes=at)) for *row, at in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
        found = progress.running_loss_stream(stream.withWatermark("ts", "10 minutes"), time=time)
        progress.store(found, f"{folder}/out", f"{folder}/state")
        return progress.settled(spark, f"{folder}/out", found.schema)

    for name, time, expected in (("waits", None, [1, 2]), ("gives-up", "ts", [1, 2, 4, 5])):
        folder = str(tmp_path / name)
        running, _ = one(folder, [("a", 1, b, 1.0, 1) for b in (5, 2, 4, 1)], time)
        assert sorted(r.batch_idx for r in running.collect()) == [1, 2]
        running, _ = one(folder, [("b", 1, 1, 2.0, 60)], time)  # an hour later
        assert sorted(r.batch_idx for r in running.where("run_id = 'a'").collect()) == expected
        running, epochs = one(folder, [("a", 1, 3, 7.0, 61), ("a", 1, 6, 1.0, 61)], time)
        assert {r.run_id: r.batches for r in epochs.collect()} == {"a": 6 if time is None else 5, "b": 1}
        assert math.isclose(epochs.where("run_id = 'a'").first().loss_sum, 12.0 if time is None else 5.0)
