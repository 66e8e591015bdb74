"""Layer states in a bucketed table: shuffled once when written, never again when read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalens.session import shared_path


def write_states(states: DataFrame, table: str | None = None, path: str | None = None, buckets: int | None = None) -> str:
    """Store ``states`` (sample_id, layer, v) in buckets by sample, sorted by sample and layer; the table's name.

    ``buckets`` (the shuffle partitions by default) is the number of files
    and of tasks that read them, so choose it for the size of the table:
    some hundred MB each.
    """
    spark = states.sparkSession
    table = table or f"states_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The same hash deals rows to tasks and to buckets, so each bucket is one file.
    placed = states.select("sample_id", F.col("layer").cast("int").alias("layer"), "v").repartition(buckets, "sample_id")
    writer = placed.write.bucketBy(buckets, "sample_id").sortBy("sample_id", "layer").format("parquet")
    writer.option("path", path or shared_path(spark, "states")).saveAsTable(table)
    return table


def read_states(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
