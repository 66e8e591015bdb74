"""Training examples: word ids, labels, padding, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratalens.functions.arrays import IGNORED_LABEL, masked_labels, ones, pad_right, truncate
from stratalens.operators import coding
from stratalens.operators.rows import enumerate_rows
from stratalens.session import save_shared


def tokenise(df: DataFrame, fn: Callable[[Column], Column], text: str = "text", ids: str = "input_ids") -> DataFrame:
    """Add token ids by a caller-supplied Column function (a Pandas UDF round a tokenizer, say)."""
    return df.withColumn(ids, fn(F.col(text)))


def vocabulary(occurrences: DataFrame) -> DataFrame:
    """Distinct words with ids from 1 in word order."""
    numbered = enumerate_rows(occurrences.select("word").distinct(), ["word"], name="id")
    return numbered.withColumn("id", (F.col("id") + 1).cast("int"))


def word_ids(df: DataFrame, key: str, text: Column, wanted: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """``key`` and, for each name in ``wanted``, the ids of words of ``text`` in order.

    The vocabulary is that of all words of ``text`` (white space separates
    them). ``wanted`` are functions that cut the array of a row's words, so
    nothing that is cut is looked up. A task codes its words by dictionaries of
    its own; only their entries are shuffled and meet the vocabulary, and
    each dictionary comes back as one array from code to id.
    """
    table = coding.coded(df, [key], {"_all": text})
    words = coding.chunk_words(table)
    found = words.join(vocabulary(words).select("word", "id"), "word")
    names = list(wanted)
    rows = table.select(key, "_chunk", *[cut(F.col("_all")).alias(name) for name, cut in wanted.items()])
    schema = T.StructType([rows.schema[key], *[T.StructField(name, T.ArrayType(T.IntegerType())) for name in names]])

    def look_up(own: pa.Table, facts: pa.Table) -> pa.Table:
        ids = facts.column("ids").combine_chunks().flatten().to_numpy() if facts.num_rows else np.zeros(0, np.int32)
        columns = [own.column(key)]
        for name in names:
            lists = own.column(name).combine_chunks()
            offsets = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())].astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[lists.flatten().to_numpy()].astype(np.int32))))
        return pa.Table.from_arrays(columns, names=[key, *names])

    return coding.with_facts(rows, coding.per_chunk(found, ids="id"), look_up, schema)


def pad_fixed(df: DataFrame, max_len: int, pad_id: int) -> DataFrame:
    """``input_ids`` cut and padded to ``max_len``, with the mask of real tokens."""
    cut = truncate(F.col("input_ids"), max_len)
    return df.withColumn("attention_mask", pad_right(ones(cut), max_len, 0)).withColumn(
        "input_ids", pad_right(cut, max_len, pad_id)
    )


def train_labels(df: DataFrame, max_len: int) -> DataFrame:
    """Prompt and completion ids joined; labels ignore the prompt. Each side is cut on its own."""
    prompt = truncate(F.col("prompt_ids"), max_len)
    completion = truncate(F.col("completion_ids"), max_len)
    ids = F.concat(prompt, completion)
    rest = [name for name in df.columns if name not in ("prompt_ids", "completion_ids")]
    return df.select(
        *rest,
        ids.alias("input_ids"),
        ones(ids).alias("attention_mask"),
        masked_labels(prompt, completion).alias("labels"),
    )


FILLS = {"attention_mask": 0, "labels": IGNORED_LABEL}


def _padded(column: pa.Array, target: np.ndarray, value: int) -> pa.Array:
    """Every list followed by ``value`` up to its length in ``target``."""
    sizes = column.value_lengths().to_numpy().astype(np.int64)
    ends, old_ends = np.cumsum(target), np.cumsum(sizes)
    out = np.full(int(ends[-1]), value, dtype=np.int32)
    out[np.arange(int(old_ends[-1])) + np.repeat((ends - target) - (old_ends - sizes), sizes)] = column.flatten().to_numpy()
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(out))


def collate_pad(examples: DataFrame, order: str, batch_size: int, pad_id: int) -> DataFrame:
    """Batches of ``batch_size`` rows in the order of ``order``, every row padded to the longest of its batch.

    Adds ``batch_id`` to the columns of ``examples`` (input_ids, attention_mask
    and labels are padded). The examples are stored once; their keys alone are
    numbered, and the keys at which every so many batches begin become the
    borders of ranges. So rows move once, each range ends where a batch ends,
    and a batch is padded where it lies in the sorted stream. ``order`` must be
    unique and not NULL; one border per task goes through the driver.
    """
    stored = save_shared(examples, "examples")
    numbered = enumerate_rows(stored.select(order), [order], name="_row")
    tasks = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches = max(-(-numbered.count() // (batch_size * tasks)), 1)
    firsts = numbered.where(F.col("_row") % (batches * batch_size) == 0).orderBy("_row").select(order).toPandas()[order].to_numpy()
    names, fills = stored.columns, {"input_ids": pad_id, **FILLS}

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts, keys.to_numpy(), side="right") - 1)

    def pad(rows: pa.Table, start: int) -> pa.RecordBatch:
        """Rows of whole batches, the first of them batch ``start``."""
        number = np.arange(rows.num_rows) // batch_size
        sizes = rows.column("input_ids").combine_chunks().value_lengths().to_numpy().astype(np.int64)
        target = np.maximum.reduceat(sizes, np.arange(0, rows.num_rows, batch_size))[number]
        columns = [_padded(rows.column(c).combine_chunks(), target, fills[c]) if c in fills else rows.column(c) for c in names]
        table = pa.Table.from_arrays([*columns, pa.array(start + number)], names=[*names, "batch_id"])
        return table.combine_chunks().to_batches()[0]

    def collate(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, start = None, None, 0
        for batch in stream:
            numbers = batch.column("_bucket").to_numpy()
            cuts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else []
            for at, end in zip(cuts, [*cuts[1:], batch.num_rows]):
                if numbers[at] != own:
                    if held is not None and held.num_rows:
                        yield pad(held, start)
                    own, held, start = numbers[at], None, int(numbers[at]) * batches
                piece = pa.Table.from_batches([batch.slice(at, end - at)])
                held = piece if held is None else pa.concat_tables([held, piece])
                whole = held.num_rows // batch_size
                if whole:
                    yield pad(held.slice(0, whole * batch_size), start)
                    held, start = held.slice(whole * batch_size), start + whole
        if held is not None and held.num_rows:
            yield pad(held, start)

    schema = T.StructType([*stored.schema.fields, T.StructField("batch_id", T.LongType())])
    placed = stored.withColumn("_bucket", bucket(order)).repartitionById(max(len(firsts), 1), F.col("_bucket"))
    return placed.sortWithinPartitions("_bucket", order).mapInArrow(collate, schema)
