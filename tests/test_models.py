import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from stratalens.inference import generate, hidden_states
from stratalens.streaming.latency import drain, windowed_latency

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def make_upper():
    calls = []

    def predict(prompts):
        calls.append(len(prompts))
        return [f"{p.upper()}:{max(calls)}" for p in prompts]

    return predict


def test_generate_adds_response_and_latency_in_batches(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(25)], "k int, prompt string").coalesce(1)
    found = generate(df, make_upper, batch_size=10).orderBy("k").collect()
    assert [r.response for r in found] == [f"P{i}:10" for i in range(25)]
    assert all(r.latency_ms >= 0 and r.started_at is not None for r in found)


def make_states():
    return lambda texts: [[[float(len(t)), 1.0], [2.0, 3.0]] for t in texts]


def test_hidden_states_are_packed(spark):
    df = spark.createDataFrame([("a",), ("abc",)], "text string")
    assert [r.layers for r in hidden_states(df, make_states).collect()] == [
        [[1.0, 1.0], [2.0, 3.0]], [[3.0, 1.0], [2.0, 3.0]]
    ]


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    log = spark.range(2000).select(
        F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("run_id"),
        F.timestamp_seconds(F.col("id") * 37).cast("timestamp_ntz").alias("started_at"),
        (F.col("id") % 11).cast("double").alias("latency_ms"),
    )
    path = str(tmp_path / "log")
    log.repartition(6).write.parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    keys = ["run_id", "window_start"]
    found = {tuple(r) for r in drain(windowed_latency(stream), keys).collect()}
    assert found == {tuple(r) for r in windowed_latency(log).collect()}
