"""Bodies in container files: NULL, empty, binary, long; blocks, files and partitions of bounded size."""

import hashlib
import random

from pyspark.sql import functions as F

from stratalens.catalog import QUERIES
from stratalens.sources import bodies


def test_bodies_of_all_pages(spark, tmp_path):
    bodies = [None, "", "a\nb\r\n", "é" * 5000, "-", " x "] + [f"page {i}" for i in range(200)]
    rows = list(enumerate(bodies))
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: (r.length, r.digest) for r in QUERIES["payload_bodies"](spark, str(tmp_path)).collect()}
    data = {i: None if b is None else b.encode() for i, b in rows}
    assert found == {i: (None, None) if b is None else (len(b), hashlib.md5(b).hexdigest()) for i, b in data.items()}


def test_binary_bodies_in_small_blocks_files_and_parts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{i}", rng.randbytes(rng.choice([0, 1, 50, 700]))) for i in range(400)] + [("none", None), (None, b"no key"), ("k1", b"again")]
    rows.append(("long", rng.randbytes(100_000)))
    path = str(tmp_path / "held")
    df = spark.createDataFrame(rows, "key string, body binary").repartition(3)
    bodies.write_bodies(df, path, fileBytes=20_000, blockBytes=3_000)
    files = [f.stat().st_size for f in (tmp_path / "held").glob("*.bodies")]
    assert len(files) > 5 and sorted(files)[-2] < 25_000
    expected = sorted(str((k or "", None if b is None else len(b), b)) for k, b in rows)
    for size in (4_000, 10**9):
        found = bodies.read_bodies(spark, path, partitionBytes=size)
        assert (found.rdd.getNumPartitions() > 20) == (size == 4_000)
        assert sorted(str((r.key, r.length, r.body and bytes(r.body) if r.body != b"" else b"")) for r in found.collect()) == expected
    parts = bodies.read_bodies(spark, path, partBytes=64).where("key = 'long'").orderBy("part").collect()
    assert len(parts) == -(-100_000 // 64) and b"".join(bytes(r.body) for r in parts) == rows[-1][1]
    assert {r.length for r in parts} == {100_000}


def test_columns_without_bodies_and_appended_writes(spark, tmp_path):
    path = str(tmp_path / "held")
    first = spark.createDataFrame([(1, b"abc"), (2, None)], "key int, body binary")
    bodies.write_bodies(first, path)
    bodies.write_bodies(first.select((F.col("key") + 2).alias("key"), "body"), path)
    bodies.write_bodies(first.where("false"), path)
    found = bodies.read_bodies(spark, path, ("length", "key"))
    assert found.columns == ["length", "key"]
    assert sorted(found.collect(), key=lambda r: r.key) == [(3, "1"), (None, "2"), (3, "3"), (None, "4")]
    (tmp_path / "held" / "stray.bodies").write_bytes(b"left by a lost attempt")
    assert bodies.read_bodies(spark, path, ("key",)).count() == 4
