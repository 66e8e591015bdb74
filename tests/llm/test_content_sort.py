"""Exact duplicates against groups in a dictionary, and how copies spread."""

import hashlib
import random
from collections import defaultdict

import pyarrow as pa

from stratalens.llm import content_sort

UP = str.maketrans(content_sort.UPPER, content_sort.LOWER)


def groups(rows):
    held = defaultdict(list)
    for doc_id, text in rows:
        held[(text or "").translate(UP)].append(doc_id)
    out = []
    for text, ids in held.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        given = False
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, keep, len(ids), i == keep and not given, hashlib.sha256(text.encode()).hexdigest()))
            given = given or i == keep
    return sorted(map(str, out))


def shown(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


ODD = [
    (1, None), (2, ""), (3, " "), (4, "É"), (5, "é"), (6, "İ"), (7, "i̇"), (8, "Σ"), (9, "ς"), (10, "ABC"), (11, "abC"), (11, "abc"),
    (None, "abc"), (None, "alone"), (None, "alone"), (None, "x"), (12, "same row"), (12, "same row"), (12, "same row"),
    (13, "L" * 300_000), (14, "l" * 300_000), (15, "l" * 299_999 + "m"), (16, "nul\x00a"), (17, "nul\x00b"),
]


def test_groups_equal_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice("aAbB") * rng.randrange(4) + rng.choice(["", "q", "Q"])) for i in range(100, 1500)]
    rows += [(i, "hot TEXT") for i in range(2000, 3000)] + ODD
    rng.shuffle(rows)
    schema = "doc_id long, text string, Kept string, run int, _norm int"
    docs = spark.createDataFrame([(d, t, "n", 1, 2) for d, t in rows], schema).repartition(6)
    assert shown(content_sort.exact_duplicates(docs)) == groups(rows)
    assert content_sort.exact_duplicates(docs.where("false")).collect() == []


def test_hot_copies_and_repeated_rows_spread(spark):
    rows = [(i, f"text {i}") for i in range(4000)] + [(i, "copied") for i in range(4000, 7000)] + [(9000, "repeated row")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = content_sort.content_runs(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_task = [r["count"] for r in runs.groupBy("part").count().collect()]
    assert len(per_task) > 4 and max(per_task) < 2 * len(rows) / len(per_task)
    assert shown(content_sort.exact_duplicates(docs)) == groups(rows)


def test_tails_that_collide(spark, monkeypatch):
    """Contents are told apart by full comparison, so a hash that takes few values changes nothing."""
    monkeypatch.setattr(content_sort.F, "xxhash64", lambda column: content_sort.F.length(column).cast("long") * 0)
    monkeypatch.setattr(content_sort, "HEAD", 1)
    rng = random.Random(3)
    rows = [(i, "t" + rng.choice("abcde") * rng.randrange(3)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert shown(content_sort.exact_duplicates(docs)) == groups(rows)


def test_a_waiting_group_keeps_no_texts():
    """A group of long copies waits as ids and digests, however many batches it comes in."""
    names = ["doc_id", "n", "last_id", "last", "text_sha256", "part", "run", "content"]
    runs, before = content_sort._Runs(0, names), pa.total_allocated_bytes()
    for k in range(20):
        columns = [pa.array([7] * 100), pa.array(["x" * 10_000] * 100), pa.array(range(100 * k, 100 * k + 100)), pa.array(["0" * 64] * 100)]
        batch = pa.RecordBatch.from_arrays(columns, names=["_tail", "_norm", "doc_id", "_sha"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        batch = pa.ipc.open_stream(sink.getvalue()).read_next_batch()  # one buffer for all columns, as from Spark
        assert not list(runs.take(batch))
    del batch, columns, sink, stream
    assert pa.total_allocated_bytes() - before < 2_000_000
    (found,) = runs.close(True)
    assert found.column("n").to_pylist() == [2000] * 2000 and found.column("last_id").to_pylist() == [1999] * 2000
