"""Corpora, evaluation items, captions, payloads, energy logs, run records, histories, plans."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stratalens import schemas
from stratalens.operators.rows import first_n

# The split each benchmark is scored on.
EVALUATION_SPLIT = {"mmlu": "test", "hellaswag": "test", "truthfulqa": "validation"}


def read_corpus(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    split: str | None = None,
    order: str | None = None,
    first: int | None = None,
) -> DataFrame:
    """A text corpus; ``split`` selects a partition folder, ``first`` the first rows by ``order``."""
    corpus = spark.read.format(fmt).load(path)
    if split is not None:
        corpus = corpus.where(F.col("split") == split)
    return corpus if first is None else first_n(corpus, [order], first)


def read_items(spark: SparkSession, path: str, benchmark: str, fmt: str = "parquet") -> DataFrame:
    """Items of a benchmark from folders ``split=...``; only the scored split is read."""
    schema = f"{schemas.ITEMS[benchmark]}, split string"
    items = spark.read.format(fmt).schema(schema).load(path)
    return items.where(F.col("split") == EVALUATION_SPLIT[benchmark]).drop("split")


def read_captions(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Caption records, from one object per line or from an envelope file with ``samples``."""
    if layout == "lines":
        return spark.read.schema(schemas.CAPTION_LINES).json(path)
    envelope = spark.read.schema(schemas.CAPTION_ENVELOPE).option("multiLine", True).json(path)
    return envelope.select("model_id", "prompt", F.explode("samples").alias("s")).select("model_id", "prompt", "s.*")


def write_captions(captions: DataFrame, path: str) -> None:
    """One object per line, without the image bytes."""
    captions.drop("payload").write.mode("append").json(path)


def read_payloads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Image bytes of a landed folder, keyed by file name; joins replace the download."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("img_file"), "length", F.col("content").alias("payload")
    )


def read_energy_log(spark: SparkSession, path: str) -> DataFrame:
    """The energy log, its columns found by name; an absent column is NULL, as is a value that cannot be read.

    Files of a folder must agree in their headers. An empty frame when the file does not exist.
    """
    fields = T.StructType.fromDDL(schemas.ENERGY_LOG).fields
    try:
        stored = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.ENERGY_LOG)
    return stored.select(
        *[(F.col(f"`{field.name}`") if field.name in stored.columns else F.lit(None)).try_cast(field.dataType).alias(field.name)
          for field in fields]
    )


def energy_totals(log: DataFrame) -> DataFrame:
    """One row: energy and emissions of the latest entry, zeros for an empty log."""
    latest = F.max_by(F.struct("energy_consumed", "emissions"), "timestamp")
    return log.agg(latest.alias("last")).select(
        F.coalesce("last.energy_consumed", F.lit(0.0)).alias("energy_kwh"),
        F.coalesce("last.emissions", F.lit(0.0)).alias("co2_kg"),
    )


def write_run_results(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_run_results(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """All run records of a folder, one per line or (``files``) one indented object per file."""
    return spark.read.schema(schemas.RUN_RESULT).option("multiLine", layout == "files").json(path)


def _publish(spark: SparkSession, folder: str, content: str) -> None:
    """Create the next numbered file of a log; whoever else takes the number first makes this one take a later."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    version = 1 + max((int(f.getPath().getName().split(".")[0]) for f in system.listStatus(path)), default=0)
    while True:
        target = hadoop.Path(f"{folder}/{version:020d}.json")
        if not system.exists(target):
            hidden = hadoop.Path(f"{folder}/../.{uuid.uuid4().hex}")
            out = system.create(hidden, False)
            out.write(bytearray(content.encode()))
            out.close()
            if system.rename(hidden, target):  # a file system that renames atomically lets one writer win
                return
            system.delete(hidden, False)
        version += 1


def append_history(entries: DataFrame, path: str) -> None:
    """Add accuracies (``run_id``, ``seq``, ``accuracy``); earlier ones are never rewritten.

    The rows are written first and then named by the next file of a log, so a
    reader sees all rows of an append or none. An entry whose ``run_id`` and
    ``seq`` an earlier append has holds for nothing: appends may be repeated.
    """
    name = uuid.uuid4().hex
    entries.write.parquet(f"{path}/data/append={name}")
    _publish(entries.sparkSession, f"{path}/log", json.dumps({"append": name}))


def read_history(spark: SparkSession, path: str, layout: str = "table") -> DataFrame:
    """The history; unreadable files fail instead of restarting it. Order is ``seq``.

    With ``array``, every file is a JSON array of accuracies, named after its run.
    """
    if layout == "table":
        log = spark.read.schema("append string").json(f"{path}/log").select(
            "append", F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long").alias("version")
        )
        rows = spark.read.schema(f"{schemas.HISTORY}, append string").parquet(f"{path}/data").join(log, "append")
        first = F.min(F.struct("version", "accuracy"))
        return rows.groupBy("run_id", "seq").agg(first.alias("first")).select("run_id", "seq", "first.accuracy")
    files = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "array<double>", {"mode": "FAILFAST"})
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.json)?$", 1)
    return files.select(name.alias("run_id"), F.posexplode(listed).alias("seq", "accuracy")).select(
        "run_id", (F.col("seq") + 1).cast("long").alias("seq"), "accuracy"
    )


def write_plans(plans: DataFrame, path: str) -> None:
    """Plans as JSON lines, which are valid YAML as well."""
    plans.write.mode("append").json(path)


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PLAN).json(path)
