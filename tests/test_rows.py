import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import rows


def test_numbers_are_contiguous_and_in_order(spark):
    keys = random.Random(1).sample(range(-(10**12), 10**12), 5000)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    found = rows.enumerate_rows(df, ["k"]).collect()
    assert {r.k: r.row_idx for r in found} == {k: i for i, k in enumerate(sorted(keys))}


def test_numbers_restart_within_keys_even_when_one_key_is_hot(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 else f"g{rng.randrange(40)}", rng.randrange(50), i) for i in range(6000)]
    data += [(None, 1, -1), (None, 0, -2)]
    df = spark.createDataFrame(data, "g string, a int, b long").repartition(5)
    found = rows.enumerate_rows(df, ["a", "b"], within=["g"]).collect()
    expected, seen = {}, {}
    for g, a, b in sorted(data, key=lambda r: (r[0] or "", r[1], r[2])):
        expected[b] = seen.get(g, 0)
        seen[g] = expected[b] + 1
    assert {r.b: r.row_idx for r in found} == expected


def test_first_n_is_capped_or_strict(spark):
    df = spark.range(5)
    assert [r.id for r in rows.first_n(df, ["id"], 3).collect()] == [0, 1, 2]
    assert rows.first_n(df, ["id"], 10).count() == 5
    with pytest.raises(ValueError):
        rows.first_n(df, ["id"], 10, strict=True)


@pytest.mark.parametrize("n", [0, 1, 49, 50, 333, 998, 1000, 5000])
def test_first_n_by_the_n_th_key(spark, n):
    rng = random.Random(n)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), i, "x") for i in range(1000)]
    df = spark.createDataFrame(data, "a int, b string, _row long, c string").repartition(6)
    found = rows.first_n(df, ["a", "b", "_row"], n, few=0) if n else rows.first_n(df, ["a", "b", "_row"], n)
    expected = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))[:n]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected))
    ties = rows.first_n(df, ["a"], n, few=0).collect() if n else []
    assert sorted((r.a or 0) for r in ties) == sorted((r[0] or 0) for r in data)[:n]


def test_numbers_beside_columns_of_any_name(spark):
    df = spark.createDataFrame([(3, 1, 7, 0), (2, 1, 8, 0), (9, 2, 9, 0)], "_slot int, _rows int, _part int, _First int")
    found = rows.enumerate_rows(df, ["_slot"], within=["_rows"]).collect()
    assert sorted(tuple(r) for r in found) == [(2, 1, 8, 0, 0), (3, 1, 7, 0, 1), (9, 2, 9, 0, 0)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 1024])
def test_permutations_are_orders_that_can_be_followed_both_ways(spark, n):
    numbered = spark.range(n).withColumnRenamed("id", "row_idx").withColumn("_x", F.lit("kept"))
    orders = []
    for epoch in (0, 1):
        order = rows.Permutation(n, seed=3)
        found = {r.row_idx: r.place for r in order.with_places(numbered, epoch).collect()}
        assert sorted(found.values()) == list(range(n)) and sorted(found) == list(range(n))
        assert all(order.place_of(row, epoch) == place and order.row_at(place, epoch) == row for row, place in found.items())
        orders.append([found[i] for i in range(n)])
    if n > 90:
        assert orders[0] != orders[1]
        moved = [abs(a - i) for i, a in enumerate(orders[0])]
        assert 0.25 < sum(moved) / n / n < 0.42  # a third of n on average for a random order
    assert rows.Permutation(0).with_places(numbered.where("false"), 0).collect() == []


def test_far_places_without_the_rows():
    order = rows.Permutation(10**13 + 7, seed=1)
    for row in (0, 1, 5 * 10**12, 10**13 + 6):
        place = order.place_of(row, 4)
        assert 0 <= place < order.n and order.row_at(place, 4) == row


def test_batches_and_the_short_last_one(spark):
    df = spark.range(10)
    sizes = {r.batch_id: r["count"] for r in rows.assign_batches(df, ["id"], 4).groupBy("batch_id").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 2}
    full = rows.assign_batches(df, ["id"], 4, full_only=True)
    assert sorted(r.id for r in full.collect()) == list(range(8))


def test_shuffle_repeats_whatever_the_partitions(spark):
    df = spark.range(200)
    first = [r.id for r in rows.shuffle_rows(df, "id", 1).collect()]
    again = [r.id for r in rows.shuffle_rows(df.repartition(9), "id", 1).collect()]
    other = [r.id for r in rows.shuffle_rows(df, "id", 2).collect()]
    assert first == again and first != other and sorted(first) == list(range(200))


def test_window_never_sees_all_rows(spark):
    df = spark.range(10_000)
    plan = rows.enumerate_rows(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert rows.enumerate_rows(df, ["id"]).agg(F.max("row_idx")).first()[0] == 9999
