import math

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from stratalens.functions.vectors import angular_distance
from stratalens.operators import blocks, rows

N_LAYERS, DIM = 6, 5


def brute(a, b):
    cosine = np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-8)
    return math.acos(min(1.0, max(-1.0, cosine))) / math.pi


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    found = rng.normal(size=(13, N_LAYERS + 1, DIM)).astype(np.float32)
    found[0, 2] = 0
    found[1, 3] = found[1, 2]
    found[2, 4] = -found[2, 3]
    return found


@pytest.fixture(scope="module")
def states(spark, vectors):
    data = [
        (s, layer, vectors[s, layer].tolist()) for s in range(len(vectors)) for layer in range(N_LAYERS + 1)
    ]
    return spark.createDataFrame(data, "sample_id long, layer int, v array<float>").repartition(6)


def expected(vectors, samples, n):
    return {
        i + 1: np.mean([brute(vectors[s, i + 1].astype(float), vectors[s, i + 1 + n].astype(float)) for s in samples])
        for i in range(N_LAYERS - n)
    }


def test_distance_of_special_pairs(spark):
    df = spark.createDataFrame(
        [([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [1.0, 2.0]), ([1.0, 2.0], [-1.0, -2.0]), ([1.0, 0.0], [0.0, 5.0])],
        "a array<float>, b array<float>",
    )
    found = [r[0] for r in df.select(angular_distance(F.col("a"), F.col("b"))).collect()]
    assert found == pytest.approx([0.5, 0.0, 1.0, 0.5], abs=1e-7)


def test_all_blocks_equal_the_plain_loop(states, vectors):
    packed = blocks.pack_layers(blocks.drop_embedding_state(states), N_LAYERS)
    found = blocks.block_distances(packed).collect()
    assert len(found) == N_LAYERS * (N_LAYERS - 1) // 2
    for row in found:
        assert row.block_end == row.block_start + row.n
        assert row.average_distance == pytest.approx(expected(vectors, range(13), row.n)[row.block_start], abs=1e-7)


def test_kernel_equals_the_join_of_pairs(states):
    kept = blocks.drop_embedding_state(states)
    pairs = blocks.pair_layers(kept, 2).groupBy("low_layer").agg(
        F.avg(angular_distance(F.col("low_v"), F.col("high_v"))).alias("d")
    )
    joined = {r.low_layer + 1: r.d for r in pairs.collect()}
    packed = blocks.block_distances(blocks.pack_layers(kept, N_LAYERS), n=2)
    assert {r.block_start: r.average_distance for r in packed.collect()} == pytest.approx(joined, abs=1e-9)


def test_missing_states_are_left_out(spark):
    data = [(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (0, 2, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (1, 2, [1.0, 0.0])]
    states = spark.createDataFrame(data, "sample_id long, layer int, v array<float>")
    found = blocks.block_distances(blocks.pack_layers(states, 3)).collect()
    assert {(r.n, r.block_start): round(r.average_distance, 6) for r in found} == {(1, 1): 0.5, (1, 2): 0.5, (2, 1): 0.0}


def test_unequal_dimensions_fail(spark):
    states = spark.createDataFrame(
        [(0, 0, [1.0, 0.0]), (0, 1, [0.0])], "sample_id long, layer int, v array<float>"
    )
    with pytest.raises(PythonException, match="dimension"):
        blocks.block_distances(blocks.pack_layers(states, 2)).collect()


def test_batch_means_average_to_the_plain_mean(states, vectors):
    kept = blocks.drop_embedding_state(states)
    packed = blocks.pack_layers(kept, N_LAYERS)
    batches = rows.assign_batches(kept.select("sample_id").distinct(), ["sample_id"], 4, full_only=True)
    per_batch = blocks.batch_block_distance(packed, batches)
    assert per_batch.select("batch_id").distinct().count() == 3
    first = per_batch.where("batch_id = 1 and n = 3").collect()
    assert {r.block_start: r.average_distance for r in first} == pytest.approx(
        expected(vectors, range(4, 8), 3), abs=1e-7
    )
    means = per_batch.where("n = 1").groupBy("block_start").agg(F.avg("average_distance").alias("d")).collect()
    assert {r.block_start: r.d for r in means} == pytest.approx(expected(vectors, range(12), 1), abs=1e-7)


def test_distance_is_symmetric_and_ignores_scale(states):
    pairs = blocks.pair_layers(states, 1)
    a, b = F.col("low_v"), F.col("high_v")
    scaled = F.transform(a, lambda x: x * 7)
    found = pairs.select(
        angular_distance(a, b).alias("d"), angular_distance(b, a).alias("e"), angular_distance(scaled, b).alias("f")
    ).collect()
    for row in found:
        assert 0 <= row.d <= 1 and row.d == pytest.approx(row.e, abs=1e-9) and row.d == pytest.approx(row.f, abs=1e-6)


def test_last_token_is_the_highest_unmasked_position(spark):
    data = [(0, 0, p, int(p < 3), [float(p)]) for p in range(5)] + [(1, 0, p, 1, [float(10 + p)]) for p in range(2)]
    states = spark.createDataFrame(data, "sample_id long, layer int, pos int, mask int, v array<float>")
    found = {r.sample_id: (r.pos, r.v) for r in blocks.last_token_state(states).collect()}
    assert found == {0: (2, [2.0]), 1: (1, [11.0])}


def test_sample_without_token_fails_and_is_named(spark):
    data = [(0, 0, 0, 1, [1.0]), (7, 0, 0, 0, [1.0])]
    states = spark.createDataFrame(data, "sample_id long, layer int, pos int, mask int, v array<float>")
    assert [r.sample_id for r in blocks.samples_without_token(states).collect()] == [7]
    with pytest.raises(Exception, match="no position with mask 1"):
        blocks.last_token_state(states).collect()


def test_best_block_takes_the_first_tie_and_never_nan(spark):
    data = [(1, 1, 0.5), (1, 2, 0.25), (1, 3, 0.25), (2, 1, float("nan")), (2, 2, 0.75), (3, 1, float("nan"))]
    df = spark.createDataFrame(data, "n int, block_start int, average_distance double").repartition(5)
    found = {r.n: (r.block_start, r.block_end, r.average_distance) for r in blocks.best_block(df).collect()}
    assert found == {1: (2, 3, 0.25), 2: (2, 4, 0.75)}


def test_matrix_holds_the_rows_in_numeric_order(spark):
    data = [(2, 1, 3, 0.2), (10, 1, 11, 0.1), (2, 2, 4, 0.3)]
    df = spark.createDataFrame(data, "n int, block_start int, block_end int, average_distance double")
    by_start = blocks.distance_matrix(df, [2, 10])
    assert by_start.columns == ["layer", "n_2", "n_10"]
    assert {tuple(r) for r in by_start.collect()} == {(1, 0.2, 0.1), (2, 0.3, None)}
    by_end = blocks.distance_matrix(df, [2, 10], axis="end")
    assert {tuple(r) for r in by_end.collect()} == {(2, 0.2, None), (3, 0.3, None), (10, None, 0.1)}


def test_min_distance_lists_all_means(spark):
    data = [(1, 2, 0.25), (1, 1, 0.5), (1, 3, 0.25), (2, 1, float("nan")), (2, 2, 0.75)]
    df = spark.createDataFrame(data, "n int, block_start int, average_distance double").repartition(5)
    found = {r.n: r for r in blocks.min_distance(df).collect()}
    assert (found[1].min_distance, found[1].layer_idx, found[1].mean_distances) == (0.25, 1, [0.5, 0.25, 0.25])
    assert math.isnan(found[2].min_distance)
