"""Texts as arrays of small integers, with one dictionary of words per chunk of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratalens.session import save_shared

#: Words of a chunk: what a task holds at once, and all that one dictionary serves. A longer text is a chunk of its own.
CHUNK_WORDS = 1 << 20
#: Words that are worked on at once where texts do not depend on each other; a longer text is taken alone.
STEP_WORDS = 1 << 16


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each has; NULL has none."""
    found = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    flat = found.flatten()
    filled = pc.not_equal(flat, "")
    row = np.repeat(np.arange(len(texts)), found.value_lengths().to_numpy())
    return flat.filter(filled), np.bincount(row[filled.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _cuts(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """First row and end of stretches of rows that are not much larger than ``most`` together."""
    block = (np.cumsum(size) - size) // most
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    return list(zip(starts, [*starts[1:], len(size)]))


def pieces(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts are not much longer than a chunk can hold (six bytes a word)."""
    size = sum(pc.binary_length(batch.column(name).fill_null("")).cast(pa.int64()).to_numpy() for name in names)
    for start, end in _cuts(size, 6 * CHUNK_WORDS):
        yield batch.slice(start, end - start)


def steps(rows: pa.Table, names: Sequence[str]) -> Iterator[pa.Table]:
    """Slices of coded rows whose lists of codes have not many more than ``STEP_WORDS`` words together."""
    for start, end in _cuts(sum(pc.list_value_length(rows.column(name)).to_numpy() for name in names), STEP_WORDS):
        yield rows.slice(start, end - start)


def coded(df: DataFrame, keys: Sequence[str], texts: Mapping[str, Column]) -> DataFrame:
    """``keys``, ``_chunk`` and an array of codes for each of ``texts``, stored once.

    A text's words are what white space (ASCII) separates in it. A task codes a
    chunk of rows at a time: its distinct words get the codes 0, 1, ... and
    stand, in that order, in ``_words`` of the chunk's last row (NULL in all
    other rows). So no word is shuffled, and a table of facts about words
    meets at most the distinct words of each chunk.
    """
    names = list(texts)
    chosen = df.select(*keys, *[column.cast("string").alias(name) for name, column in texts.items()])
    fields = [chosen.schema[key] for key in keys]
    fields += [T.StructField("_chunk", T.LongType())] + [T.StructField(name, T.ArrayType(T.IntegerType())) for name in names]
    schema = T.StructType([*fields, T.StructField("_words", T.ArrayType(T.StringType()))])

    def finish(held: list, number: int) -> pa.RecordBatch:
        words = pa.chunked_array([flat for _, lists in held for flat, _ in lists], pa.large_string()).combine_chunks().dictionary_encode()
        codes, at, columns = words.indices.to_numpy().astype(np.int32), 0, {name: [] for name in names}
        for _, lists in held:
            for name, (flat, counts) in zip(names, lists):
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                columns[name].append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes[at : at + len(flat)])))
                at += len(flat)
        rows = pa.Table.from_batches([batch for batch, _ in held]).combine_chunks()
        n = rows.num_rows
        entries = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary.cast(pa.string()))
        listed = pa.concat_arrays([pa.nulls(n - 1, entries.type), entries])
        own = [rows.column(key) for key in keys] + [pa.array(np.full(n, number))] + [pa.concat_arrays(columns[name]) for name in names]
        return pa.Table.from_arrays([*own, listed], names=[f.name for f in schema.fields]).combine_chunks().to_batches()[0]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 33, [], 0
        for whole in batches:
            for batch in pieces(whole, names) if whole.num_rows else ():
                lists = [split_words(batch.column(name)) for name in names]
                size = sum(len(flat) for flat, _ in lists)
                if held and n + size > CHUNK_WORDS:
                    yield finish(held, number)
                    number, held, n = number + 1, [], 0
                held.append((batch.select(list(keys)), lists))
                n += size
        if held:
            yield finish(held, number)

    return save_shared(chosen.mapInArrow(code, schema), "coded")


def chunk_words(table: DataFrame) -> DataFrame:
    """``_chunk, _code, word``: the distinct words of every chunk of a coded table."""
    return table.where("_words IS NOT NULL").select("_chunk", F.posexplode("_words").alias("_code", "word"))


def per_chunk(words: DataFrame, **facts: str) -> DataFrame:
    """``_chunk`` and, for each of ``facts``, a column's values in the order of the codes (one row of ``words`` each)."""
    entry = F.struct("_code", *[F.col(column).alias(name) for name, column in facts.items()])
    listed = words.groupBy("_chunk").agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    return listed.select("_chunk", *[F.col(f"_entries.{name}").alias(name) for name in facts])


def with_facts(
    rows: DataFrame, facts: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str
) -> DataFrame:
    """``kernel`` of the rows of every chunk and its row of ``facts`` (none if the chunk has no word)."""
    facts = facts.withColumnRenamed("_chunk", "_facts_of")  # both come from one stored table
    return rows.groupBy("_chunk").cogroup(facts.groupBy("_facts_of")).applyInArrow(kernel, schema)
