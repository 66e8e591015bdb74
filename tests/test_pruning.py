import pytest
from pyspark.sql import functions as F

from stratalens.plans import pruning


@pytest.fixture(scope="module")
def block(spark):
    return spark.createDataFrame([("m", 5, 9, 14)], "model string, n int, block_start int, block_end int")


@pytest.mark.parametrize(
    ("rule", "removed"),
    [("half_open", range(9, 14)), ("left_open", range(10, 15)), ("closed", range(9, 15))],
)
def test_rules_remove_their_layers(spark, block, rule, removed):
    kept = {r.layer for r in pruning.kept_layers(block, 26, [rule]).collect()}
    assert kept == set(range(26)) - set(removed)
    layers = spark.range(26).select(F.lit("m").alias("model"), F.col("id").cast("int").alias("layer"))
    assert {r.layer for r in pruning.apply_plans(block, layers, rule).collect()} == kept
    slices = pruning.slice_rows(pruning.pruning_plans(block, 26, rule)).collect()
    assert {layer for s in slices for layer in range(s.layer_from, s.layer_to)} == kept


def test_empty_slices_are_dropped(spark):
    blocks = spark.createDataFrame(
        [("m", 3, 0, 3), ("m", 4, 4, 8), ("m", 2, 3, 5)], "model string, n int, block_start int, block_end int"
    )
    found = pruning.slice_rows(pruning.pruning_plans(blocks, 8)).collect()
    assert {(r.n, r.slice_idx, r.layer_from, r.layer_to) for r in found} == {
        (3, 0, 3, 8), (4, 0, 0, 4), (2, 0, 0, 3), (2, 1, 5, 8),
    }


def test_plan_shape(block):
    plan = pruning.pruning_plans(block, 26).first().plan
    assert (plan.merge_method, plan.dtype) == ("passthrough", "bfloat16")
    assert [s.sources[0].model for s in plan.slices] == ["m", "m"]
    assert [s.sources[0].layer_range for s in plan.slices] == [[0, 9], [14, 26]]
