"""What several operators share: tables, word counts, running totals over a range sort, free column names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from stratalens.session import save_shared

#: A word: a run of anything but the space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of the whole text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_of(key: Column) -> Column:
    """Unsigned CRC-32 of the key as decimal text; NULL counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares names without case)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_fields(df: DataFrame, **fields: str) -> T.StructType:
    """The schema of ``df`` and further fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields.items()))])


def running_totals(df: DataFrame, order: Sequence[str], value: str, within: str | None = None) -> DataFrame:
    """``df`` with ``total``: the inclusive sum of ``value`` by ``order``, restarting for every ``within`` key.

    Rows are range-partitioned by key and order, so a key with a third of all
    rows spreads over many tasks. Each task adds up what it holds; the placed
    rows are stored once, as a range shuffle computed twice may cut elsewhere,
    and only one sum per task and key is added up beyond the tasks. ``order``
    should end in a column that tells rows apart; ``within`` must not be NULL.
    """
    keys = [*([within] if within else []), *order]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False))
            if within:
                group = batch.column(within).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                before = np.where(starts > 0, sums[starts - 1], 0)
                if last == group[0]:
                    before[0] -= carried
                sums = sums - np.repeat(before, np.diff(np.r_[starts, len(group)]))
                last = group[-1]
            else:
                sums = sums + carried
            carried = sums[-1]
            columns = [*batch.columns, pa.array(sums, pa.int64()), pa.array(np.full(len(sums), part, "int32"))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "total", "_part"])

    schema = with_fields(df, total="long", _part="int")
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(add_up, schema)
    placed = save_shared(placed, "totals")
    by = [within] if within else []
    sums = placed.groupBy("_part", *by).agg(F.max("total").alias("_sum"))
    # One row per task and key: the window holds at most as many rows per key as there are range partitions.
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("_part", *by, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    moved = placed.join(shifts, ["_part", *by])
    return moved.select(*df.columns, (F.col("total") + F.col("_before")).alias("total"))
