"""Joins with hot keys are split at run time, by their size and not by their share."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators.accuracy import match_predictions

SMALL_SIZES = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_sizes(spark):
    for key, value in SMALL_SIZES.items():
        spark.conf.set(key, value)
    yield
    for key in SMALL_SIZES:
        spark.conf.unset(key)


def test_a_third_and_a_thousandth_of_the_rows(spark, small_sizes, tmp_path):
    n = 200_000
    item = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1001 == 1, 8).otherwise(F.col("id") + 100)
    run = F.sha2(F.col("id").cast("string"), 256).alias("run_id")  # does not compress
    spark.range(n).select(item.alias("item_id"), run, F.lit(1).alias("predicted")).write.parquet(str(tmp_path / "p"))
    items = spark.range(n + 100).select(F.col("id").alias("item_id"), F.lit(1).alias("truth"))
    items.write.parquet(str(tmp_path / "i"))
    joined = match_predictions(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "i")))
    held = joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("run_id"))
    sizes = [r["n"] for r in held.collect()]
    assert sum(sizes) == n and max(sizes) < n / 8
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
