import random

import pytest
from pyspark.sql import functions as F

from stratalens.functions.arrays import truncate
from stratalens.operators import coding, tokens


def ids_by_loop(texts):
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t.split()}))}
    return [[vocabulary[w] for w in t.split()] for t in texts]


def test_ids_are_those_of_the_loop_whole_and_cut(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("the" if rng.random() < 0.5 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(60))) for _ in range(400)]
    texts[3] = ""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    expected = dict(enumerate(ids_by_loop(texts)))
    wanted = {"input_ids": lambda w: w, "cut": lambda w: F.slice(w, 2, 5)}
    for size in (coding.CHUNK_WORDS, 300):  # one chunk a task, and many
        monkeypatch.setattr(coding, "CHUNK_WORDS", size)
        found = tokens.word_ids(df, "doc_id", F.col("text"), wanted).collect()
        assert {r.doc_id: r.input_ids for r in found} == expected
        assert {r.doc_id: r.cut for r in found} == {k: ids[1:6] for k, ids in expected.items()}


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t\n\x0b\x0c\r ")], "doc_id long, text string")
    found = tokens.word_ids(df, "doc_id", F.col("text"), {"ids": lambda w: w}).collect()
    assert sorted((r.doc_id, r.ids) for r in found) == [(1, []), (2, []), (3, [])]
    assert tokens.word_ids(df.where("false"), "doc_id", F.col("text"), {"ids": lambda w: w}).collect() == []


def test_words_are_shuffled_once_per_chunk(spark):
    df = spark.createDataFrame([(i, "the same words here " * 50) for i in range(400)], "doc_id long, text string").repartition(4)
    assert coding.chunk_words(coding.coded(df, ["doc_id"], {"ids": F.col("text")})).count() == 4 * 4


def test_tokenise_takes_any_column_function(spark):
    df = spark.createDataFrame([("abc",)], "text string")
    found = tokens.tokenise(df, lambda t: F.transform(F.split(t, ""), lambda c: F.ascii(c)))
    assert found.first().input_ids == [97, 98, 99]


def test_pad_fixed(spark):
    df = spark.createDataFrame([([1, 2],), (list(range(9)),), ([],)], "input_ids array<int>")
    found = tokens.pad_fixed(df, 4, 99).collect()
    assert [(r.input_ids, r.attention_mask) for r in found] == [
        ([1, 2, 99, 99], [1, 1, 0, 0]), ([0, 1, 2, 3], [1] * 4), ([99] * 4, [0] * 4)
    ]


def test_labels_ignore_the_prompt_and_each_side_is_cut(spark):
    df = spark.createDataFrame(
        [(1, [1, 2, 3, 4], [7, 8, 9, 10]), (2, [1], [])], "k int, prompt_ids array<int>, completion_ids array<int>"
    )
    found = {r.k: r for r in tokens.train_labels(df, 3).collect()}
    assert found[1].input_ids == [1, 2, 3, 7, 8, 9] and found[1].labels == [-100] * 3 + [7, 8, 9]
    assert found[1].attention_mask == [1] * 6
    assert (found[2].input_ids, found[2].labels) == ([1], [-100])


@pytest.mark.parametrize("batch_size", [1, 3, 7, 1000])
def test_collate_pads_to_the_longest_of_the_batch(spark, batch_size):
    rng = random.Random(batch_size)
    rows = {3 * k: [rng.randrange(1, 99) for _ in range(rng.choice([0, 1, 5, 20]))] for k in range(250)}
    data = [(k, ids, [1] * len(ids), [-100] * min(2, len(ids)) + ids[2:], "x") for k, ids in rows.items()]
    rng.shuffle(data)
    schema = "k int, input_ids array<int>, attention_mask array<int>, labels array<int>, extra string"
    df = spark.createDataFrame(data, schema).repartition(5)
    found = {r.k: r for r in tokens.collate_pad(df, "k", batch_size, 0).collect()}
    assert len(found) == len(rows)
    for at, k in enumerate(sorted(rows)):
        first = at - at % batch_size
        longest = max(len(rows[j]) for j in sorted(rows)[first : first + batch_size])
        ids, gap = rows[k], longest - len(rows[k])
        assert found[k].batch_id == at // batch_size and found[k].extra == "x"
        assert found[k].input_ids == ids + [0] * gap
        assert found[k].attention_mask == [1] * len(ids) + [0] * gap
        assert found[k].labels == [-100] * min(2, len(ids)) + ids[2:] + [-100] * gap
    assert tokens.collate_pad(df.where("false"), "k", batch_size, 0).collect() == []


def test_truncate_keeps_the_prefix(spark):
    df = spark.createDataFrame([(list(range(6)),)], "x array<int>")
    assert df.select(truncate(F.col("x"), 4)).first()[0] == [0, 1, 2, 3]
