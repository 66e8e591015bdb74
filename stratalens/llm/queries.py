"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalens.llm import (
    brown,
    content_sort,
    embeddings,
    langid,
    merkle,
    minhash,
    mixing,
    packing,
    periodic,
    sharding,
    simplex,
    token_files,
    warc,
)
from stratalens.llm.common import table
from stratalens.llm.sql import ORACLE  # noqa: F401, read with QUERIES
from stratalens.session import spread


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path(token_files.TOKENIZER))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = token_files.token_count(F.col("text"), public_tokenizers.path(token_files.TOKENIZER))
    return packing.pack(spread(table(spark, sf_dir, "documents"), "doc_id"), n_tokens=tokens)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scores(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.fair_queue(table(spark, sf_dir, "documents"))
    each = found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_planted_runs(table(spark, sf_dir, "documents")))
    found = found.select("doc_id", "runs", "collapsed", periodic.longest(F.col("runs")).alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex.clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_langid,
        op2_embeddings,
        op3_warc,
        op4_merkle,
        op5_tokens,
        op6_packing,
        op7_minhash,
        op8_brown,
        op9_sharding,
        op10_mixing,
        op11_runs,
        op12_content,
        op13_simplex,
    )
}
