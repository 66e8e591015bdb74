"""Widths of shingles: the stage takes five words, op7 two."""

import pyarrow as pa

import corpus_pipeline
from stratalens.llm import minhash, words


def test_one_word_in_twenty_is_no_copy_for_the_stage(spark):
    text = [f"w{i}" for i in range(100)]
    near = [f"x{i}" if i % 20 == 10 else w for i, w in enumerate(text)]
    close = [*text[:-1], "last"]
    rows = [(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(close))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 2}
    assert {r.doc_id for r in minhash.deduplicated(docs, width=2).collect()} == {1}


def test_shingles_of_a_width():
    found = [len(x) for x in words.shingle_sets(pa.array(["a b c d e f a b c d e", "a b c", "a", "", None]), 5)]
    assert found == [6, 1, 1, 0, 0]  # a b c d e comes twice
