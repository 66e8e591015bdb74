"""A training corpus from ``documents``: language, near-duplicates, mixture, batches.

Every stage is a function of (spark, docs, sf_dir). All but the last return
rows with the columns of ``docs``; each works on all rows that its predecessor
kept, written as Parquet and read again. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalens.llm import langid, minhash, mixing, packing, token_files
from stratalens.session import save_shared

SHINGLE_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; those without a letter (NULL and empty texts too) or with no clear language go.

    Repeated rows are decided on alike; of languages with the same score the first by name wins.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id; of rows that repeat it, one.

    Texts without words are no near-duplicates of anything and stay.
    """
    return minhash.deduplicated(docs, width=SHINGLE_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it (not at all, once or twice).

    A NULL source is a source, the last; ties of the queue go by source, seeded key and size, so reruns agree.
    """
    return mixing.mixed(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in padded batches, lengths in token ids: doc_id, piece, start, length, bucket, batch, row.

    A text without ids (NULL or empty) is one piece of length 0 in no batch; a
    document that stands in the mixture twice is packed twice.
    """
    tokens = token_files.token_count(F.col("text"), public_tokenizers.path(token_files.TOKENIZER), keep=False)
    return packing.pack(docs, n_tokens=tokens)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("batches", batches)]

#: SQL cannot express the classifier, so the pipeline is tested against a plain version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
