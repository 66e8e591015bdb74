"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from stratalens.llm.common import with_fields
from stratalens.session import shared_path

#: Parameters of the registered query.
SHARDS = 8
BUCKET_BYTES = 32 << 20
SEED = 9


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Shuffle ``docs`` (doc_id, text) into ``shards`` folders of Parquet below ``path``; the files as a table.

    Pass 1 scatters the records by a seeded hash of id and text into buckets of
    some ``bucket_bytes`` each (as many buckets as shuffle partitions at
    least). Pass 2 reads one bucket per task, brings it into a fixed order,
    applies a seeded Fisher-Yates shuffle and writes it. Buckets follow each
    other in one global order; record ``p`` of N goes to shard
    ``floor(p * shards / N)``, so shards differ by one record at most, and
    ``slot`` counts from 0 in every shard. Same rows, same seed: same shards.

    Result: doc_id, text, slot, shard. Shuffle and output hold each text once;
    a task holds one bucket. NULL ids and texts are records like others;
    repeated rows are all kept; an empty table gives an empty result; other
    columns are not written.
    """
    spark = docs.sparkSession
    records = docs.select("doc_id", "text").withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "text"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n_buckets = max(-(-total // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = records.withColumn("_bucket", F.pmod("_hash", F.lit(n_buckets)).cast("int"))
    counted = records.groupBy("_bucket").count().collect()  # one number per bucket_bytes of text
    counts = np.zeros(n_buckets + 1, dtype=np.int64)
    for bucket, count in counted:
        counts[bucket + 1] = count
    first = np.cumsum(counts)
    n = int(first[-1])

    def shuffle_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        bucket = pa.Table.from_batches(held)
        own = bucket.column("_bucket")[0].as_py()
        bucket = bucket.take(pc.sort_indices(bucket, [("_hash", "ascending"), ("doc_id", "ascending")]))
        # Generator.permutation is a Fisher-Yates shuffle.
        bucket = bucket.take(pa.array(np.random.default_rng([seed, own]).permutation(len(bucket))))
        place = first[own] + np.arange(len(bucket))
        shard = place * shards // n
        slot = place - -(-shard * n // shards)
        out = pa.table([bucket["doc_id"], bucket["text"], pa.array(slot), pa.array(shard.astype("int32"))],
                       names=["doc_id", "text", "slot", "shard"])
        yield from out.to_batches(max_chunksize=1000)

    schema = with_fields(docs.select("doc_id", "text"), slot="long", shard="int")
    (
        records.repartitionById(n_buckets, F.col("_bucket"))
        .mapInArrow(shuffle_bucket, schema)
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
    return spark.read.schema(schema).parquet(path)


def sharded(docs: DataFrame, **options) -> DataFrame:
    """``write_shards`` below the shared folder."""
    return write_shards(docs, shared_path(docs.sparkSession, "shards"), **options)
