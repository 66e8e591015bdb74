"""Exact duplicates by sorting contents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratalens.session import save_shared

#: Characters of the content that stand in the sampled splitters.
HEAD = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; NULL is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


class _Runs:
    """Runs of equal neighbours in a sorted stream of ``_tail, _norm, doc_id, _sha``, as batches of ``names``.

    Rows leave when their ``_tail`` changes; those of the current one wait, as
    ids and digests. Runs of a task's first and last ``_tail`` may go on in
    another task: their last row carries the content.
    """

    def __init__(self, part: int, names: list[str]):
        self.part, self.names = part, names
        self.runs, self.first = 0, True
        self.tail = self.content = None
        self.held: list[tuple[pa.RecordBatch, np.ndarray]] = []
        self.contents: dict[int, str] = {}

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        norm, tail, n = batch.column("_norm"), np.asarray(batch.column("_tail")), batch.num_rows
        new = np.ones(n, dtype=bool)
        new[1:] = ~np.asarray(pc.equal(norm.slice(1), norm.slice(0, n - 1)))
        new[0] = self.content is None or norm[0].as_py() != self.content
        run = self.runs + np.cumsum(new) - 1
        turns = np.flatnonzero(np.r_[self.tail is None or tail[0] != self.tail, tail[1:] != tail[:-1]])
        ends = turns[turns > 0][:1] if not self.held else turns[:1]
        at = 0
        for end in [*(ends if self.first else []), *turns[-1:]]:
            self._hold(batch, at, int(end), run, new)
            yield from self.close(self.first)
            at = int(end)
        self._hold(batch, at, n, run, new, waits=True)
        self.tail, self.content, self.runs = tail[-1], norm[n - 1].as_py(), int(run[-1]) + 1

    def _hold(self, batch: pa.RecordBatch, at: int, end: int, run: np.ndarray, new: np.ndarray, waits: bool = False) -> None:
        if end > at:
            # Copies: a slice would keep the texts that came in the same batch.
            self.held.append((batch.select(["doc_id", "_sha"]).take(pa.array(np.arange(at, end))), run[at:end].copy()))
            if waits or self.first:
                for row in (at + np.flatnonzero(new[at:end])).tolist():
                    self.contents[int(run[row])] = batch.column("_norm")[row].as_py()

    def close(self, edge: bool) -> Iterator[pa.RecordBatch]:
        """All that waits; ``edge``: it lies at an end of the task's range."""
        if not self.held:
            return
        rows, run = pa.Table.from_batches([b for b, _ in self.held]).combine_chunks(), np.concatenate([r for _, r in self.held])
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        ends = np.r_[starts[1:], len(run)]
        sizes, last = ends - starts, np.zeros(len(run), dtype=bool)
        last[ends - 1] = True
        content: list[str | None] = [None] * len(run)
        if edge:
            for row in (ends - 1).tolist():
                content[row] = self.contents[int(run[row])]
        self.held, self.contents, self.first = [], {}, False
        ids = rows.column("doc_id")
        columns = [
            ids, pa.array(np.repeat(sizes, sizes)), ids.take(pa.array(np.repeat(ends - 1, sizes))), pa.array(last), rows.column("_sha"),
            pa.array(np.full(len(run), self.part, dtype=np.int32)), pa.array(run), pa.array(content, pa.string()),
        ]
        yield from pa.Table.from_arrays(columns, names=self.names).to_batches(max_chunksize=10_000)


def content_runs(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` in the run of equal contents it lies in after the sort, stored.

    Columns: doc_id, n (rows of the run), last_id (its largest id), last
    (whether the row ends the run), text_sha256, part, run, and content, for
    the last rows of runs at the ends of a task's range alone.
    """
    norm = docs.select("doc_id", normalised(F.col("text")).alias("_norm"), F.monotonically_increasing_id().alias("_salt"))
    # Splitters are samples of the keys, so a long content stands for itself by its head and a hash. The id and the
    # row's place behind it let a group of copies, or of repeated rows, spread over many ranges.
    keyed = norm.select(F.substring("_norm", 1, HEAD).alias("_head"), F.xxhash64("_norm").alias("_tail"), "_norm", "doc_id", "_salt")
    ordered = keyed.repartitionByRange("_head", "_tail", "doc_id", "_salt").sortWithinPartitions("_head", "_tail", "_norm", "doc_id")
    names = ["doc_id", "n", "last_id", "last", "text_sha256", "part", "run", "content"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs = _Runs(TaskContext.get().partitionId(), names)
        for batch in batches:
            if batch.num_rows:
                yield from runs.take(batch)
        yield from runs.close(True)

    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", kind), ("n", T.LongType()), ("last_id", kind), ("last", T.BooleanType()), ("text_sha256", T.StringType()),
              ("part", T.IntegerType()), ("run", T.LongType()), ("content", T.StringType())]
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])
    return save_shared(ordered.select("_tail", "_norm", "doc_id", F.sha2("_norm", 256).alias("_sha")).mapInArrow(compare, schema), "content-runs")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text).

    Texts are equal if they are the same after lower-casing A-Z. Of equal
    texts the row with the largest doc_id is kept, ``keep_id`` in all of them.

    The contents are range-partitioned by sampled splitters and sorted, with
    spilling, in every range; equal contents are neighbours then, and
    neighbours are compared in full. Texts move once. A group of copies spreads
    over as many ranges as its rows fill; only the runs at the ends of a range
    can go on elsewhere, and these few (one or two a task) are added up by
    their full content.

    NULL is the empty text. A NULL id is smaller than any other; where all ids
    of a group are NULL, keep_id is NULL. Of rows that repeat the largest id
    exactly one is kept. An empty table gives an empty result; other columns
    are not looked at. ``docs`` should be a stored table: the place of a row
    in it takes part in the splitters.
    """
    runs = content_runs(docs)
    ends = runs.where("content IS NOT NULL").groupBy("content").agg(
        F.sum("n").alias("_size"),
        F.max(F.struct("last_id", "part", "run")).alias("_best"),
        F.collect_list(F.struct("part", "run")).alias("_runs"),  # at most one or two a task
    )
    ends = ends.select(F.explode("_runs").alias("_run"), "_size", "_best").select("_run.part", "_run.run", "_size", "_best")
    joined = runs.drop("content").join(ends, ["part", "run"], "left")
    alone = F.col("_best").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("last_id")).otherwise(F.col("_best.last_id")).alias("keep_id"),
        F.coalesce("_size", "n").alias("group_size"),
        (F.col("last") & (alone | ((F.col("_best.part") == F.col("part")) & (F.col("_best.run") == F.col("run"))))).alias("kept"),
        "text_sha256",
    )
