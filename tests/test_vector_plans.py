"""Vectors are not sorted into aggregates."""

import re

from pyspark.sql import functions as F

from stratalens.operators import blocks
from stratalens.sources.states import read_states, write_states


def states(spark):
    rows = [(s, layer, pos, int(pos <= s % 3), [float(s), float(layer), float(pos)]) for s in range(40) for layer in range(4) for pos in range(3)]
    return spark.createDataFrame(rows, "sample_id long, layer int, pos int, mask int, v array<double>").repartition(6)


def test_packed_states(spark):
    one = states(spark).where("pos = 0 AND NOT (sample_id = 7 AND layer = 2)")
    packed = blocks.pack_layers(one, 3)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    found = {r.sample_id: r.layers for r in packed.collect()}
    assert found == {
        s: [None if (s, layer) == (7, 2) else [float(s), float(layer), 0.0] for layer in range(3)] for s in range(40)
    }
    assert blocks.pack_layers(one.where("false"), 3).collect() == []


def test_last_positions(spark):
    found = {(r.sample_id, r.layer): (r.pos, r.v) for r in blocks.last_token_state(states(spark)).collect()}
    assert found == {(s, layer): (s % 3, [float(s), float(layer), float(s % 3)]) for s in range(40) for layer in range(4)}


def test_small_batches_do_not_cut_a_sample(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        packed = blocks.pack_layers(states(spark).where("pos = 1"), 4)
        assert sorted(r.sample_id for r in packed.collect()) == list(range(40))
        assert packed.where(F.exists("layers", lambda v: v.isNull())).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stored_states_meet_without_an_exchange_of_vectors(spark, tmp_path):
    one = states(spark).where("pos = 0 AND NOT (sample_id = 7 AND layer = 2)")
    stored = read_states(spark, write_states(one, path=str(tmp_path / "states"), buckets=5))
    assert len(list((tmp_path / "states").glob("*.parquet"))) == 5
    packed = blocks.pack_stored_layers(stored, 3)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert sorted(map(str, packed.collect())) == sorted(map(str, blocks.pack_layers(one, 3).collect()))
    found = blocks.block_distances(packed)
    exchanges = re.findall(r"Exchange [^\n]*", found._jdf.queryExecution().executedPlan().toString())
    assert len(exchanges) == 1 and "hashpartitioning(n#" in exchanges[0]  # of sums alone
    rounded = F.round("average_distance", 9).alias("average_distance")
    both = [sorted(map(str, d.select("n", "block_start", rounded).collect())) for d in (found, blocks.block_distances(blocks.pack_layers(one, 3)))]
    assert both[0] == both[1]
