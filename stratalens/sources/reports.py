"""Distance reports: framed text files, one per model and block size, or a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Wording of a report.
TITLE = "Analysis of Layer Similarities for "
SIZE_LINE = "Number of Layers to Skip : "
HEADER = "block_start,block_end,average_distance"
KEYS = ["dataset", "model", "n"]


def file_suffix_number(path: Column) -> Column:
    """Number after the last underscore of a CSV name; 0 without one."""
    digits = F.regexp_extract(path, r"_(\d+)\.csv$", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(0))


def report_label(path: Column, base_name: str) -> Column:
    """Last underscore part of the file name; ``base`` for the file without a suffix."""
    name = F.regexp_extract(path, r"([^/]*?)(?:\.csv)?$", 1)
    return F.when(name == base_name, "base").otherwise(F.element_at(F.split(name, "_"), -1))


def parse_best_block(trailer: Column) -> Column:
    """The first two numbers of the trailer, smaller one first."""
    numbers = F.transform(F.regexp_extract_all(trailer, F.lit(r"(\d+)"), 1), lambda d: d.cast("int"))
    return F.struct(
        F.least(F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))).alias("block_start"),
        F.greatest(F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))).alias("block_end"),
    )


def _decoded(value: Column) -> Column:
    """Percent-encoding undone; a plus sign stays one."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def _folder_value(path: Column, key: str) -> Column:
    """Value of a partition folder; the folder's own escapes are undone after those of the URL."""
    return _decoded(_decoded(F.nullif(F.regexp_extract(path, rf"/{key}=([^/]+)/", 1), F.lit(""))))


def read_distance_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all reports below ``path``, and the best block each trailer names.

    A report has one line per layer, so a whole file is a small row. The block
    size is the number in the file name, or the folder ``n=`` of our own
    layout; the data set is the parent folder or the folder ``dataset=``.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    lines = F.transform(F.split("value", "\n"), lambda line: F.rtrim(line))
    reports = text.select(
        F.coalesce(_folder_value(file, "dataset"), _decoded(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1))).alias("dataset"),
        F.coalesce(_folder_value(file, "n").cast("int"), file_suffix_number(file)).alias("n"),
        lines.alias("lines"),
    ).select(
        "dataset",
        F.trim(F.replace(F.col("lines")[0], F.lit(TITLE.rstrip()), F.lit(""))).alias("model"),
        "n",
        F.filter("lines", lambda line: line.rlike(r"^\d+,\d+,")).alias("rows"),
        F.filter("lines", lambda line: line.startswith("Layer")).alias("trailers"),
    )
    cells = F.split("row", ",")
    rows = reports.select(*KEYS, F.explode("rows").alias("row")).select(
        *KEYS,
        cells[0].cast("int").alias("block_start"),
        cells[1].cast("int").alias("block_end"),
        cells[2].cast("double").alias("average_distance"),
    )
    best = (
        reports.where("size(rows) > 0 and size(trailers) > 0")
        .withColumn("best", parse_best_block(F.element_at("trailers", -1)))
        .select(*KEYS, "best.block_start", "best.block_end")
    )
    return rows, best


def _report_text() -> Column:
    body = F.transform(
        "entries",
        lambda e: F.concat_ws(",", e["block_start"], e["block_end"], e["average_distance"]),
    )
    trailer = F.format_string("Layer %d to %d is the best block to prune.", "best.block_start", "best.block_end")
    trailer = F.when(F.size("entries") > 0, F.array(trailer)).otherwise(F.array().cast("array<string>"))
    head = F.array(
        F.concat(F.lit(TITLE), F.col("model"), F.lit(" ")),
        F.concat(F.lit(SIZE_LINE), F.col("n").cast("string"), F.lit(" ")),
        F.lit(HEADER),
    )
    return F.array_join(F.concat(head, body, trailer), "\n")


def write_distance_reports(rows: DataFrame, path: str, layout: str = "table", sizes: DataFrame | None = None) -> None:
    """Store distance rows partitioned by data set, model and ``n``, as parquet or as report texts.

    ``sizes`` (data set, model, ``n``) names all reports to write: one without rows, as for as many layers as
    the model has, is a text without rows and without a best block.
    """
    if layout == "table":
        rows.repartition(*KEYS).write.partitionBy(*KEYS).parquet(path)
        return
    entries = F.array_sort(F.collect_list(F.struct("block_start", "block_end", "average_distance")))
    least = F.min(F.when(~F.isnan("average_distance"), F.struct("average_distance", "block_start", "block_end")))
    texts = rows.groupBy(*KEYS).agg(entries.alias("entries"), least.alias("best"))  # at most one row per layer
    if sizes is not None:
        none = F.array().cast(texts.schema["entries"].dataType)
        texts = sizes.select(*KEYS).distinct().join(texts, KEYS, "left").withColumn("entries", F.coalesce("entries", none))
    texts.select(*KEYS, _report_text().alias("value")).repartition(*KEYS).write.partitionBy(*KEYS).text(path)
