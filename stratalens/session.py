"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


SPREAD = "spark.stratalens.textPartitions"


def build_session(app_name: str = "stratalens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and AQE on; on a cluster leave ``master`` to spark-submit."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache
def _test_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="stratalens-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Without the setting a cluster fails; a local-mode session, as in tests, gets one temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _test_dir(context.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/stratalens/{name}-{uuid.uuid4().hex}"


def save_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet below the shared folder and return the stored table.

    Cuts the lineage: rows placed by a range shuffle keep their place when an
    executor is lost, and later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)  # intermediate tables are written and read once or twice
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over ``spark.stratalens.textPartitions`` partitions where that is set.

    For costly work on an input of one file that Spark cannot split; else rows stay where the scan puts them.
    """
    partitions = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(partitions), key) if partitions else df
