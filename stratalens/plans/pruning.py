"""Which layers stay when a block is removed, and the plan that says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of a plan.
MERGE_METHOD = "passthrough"
DTYPE = "bfloat16"

KEEP_RULES = {
    "half_open": lambda layer, start, end: (layer < start) | (layer >= end),
    "left_open": lambda layer, start, end: (layer <= start) | (layer > end),
    "closed": lambda layer, start, end: (layer < start) | (layer > end),
}


def keep_layers(layer: Column, start: Column, end: Column, rule: str = "half_open") -> Column:
    return KEEP_RULES[rule](layer, start, end)


def kept_layers(blocks: DataFrame, n_layers: int, rules: Sequence[str] = ("half_open",)) -> DataFrame:
    """Every block against every layer of its model, keeping the layers outside the block, per rule."""
    layer = F.col("layer")
    kept = [
        F.when(keep_layers(layer, F.col("block_start"), F.col("block_end"), rule), F.lit(rule)) for rule in rules
    ]
    return (
        blocks.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(n_layers - 1))))
        .withColumn("rule", F.explode(F.array(*kept)))
        .where("rule is not null")
    )


def apply_plans(blocks: DataFrame, layers: DataFrame, rule: str = "half_open") -> DataFrame:
    """As ``kept_layers`` for a table of layers (``model``, ``layer``, ...) of many models."""
    kept = keep_layers(F.col("layer"), F.col("block_start"), F.col("block_end"), rule)
    return layers.join(blocks, "model").where(kept)


def plan_slices(
    start: Column,
    end: Column,
    n_layers: int,
    model: Column,
    rule: str = "half_open",
    merge_method: str = MERGE_METHOD,
    dtype: str = DTYPE,
) -> Column:
    """The layer ranges that remain, as half-open slices; empty ones are left out."""
    low_end, high_start = {
        "half_open": (start, end),
        "left_open": (start + 1, end + 1),
        "closed": (start, end + 1),
    }[rule]
    ranges = F.filter(
        F.array(F.array(F.lit(0), low_end.cast("int")), F.array(high_start.cast("int"), F.lit(n_layers))),
        lambda r: r[0] < r[1],
    )
    slices = F.transform(
        ranges, lambda r: F.struct(F.array(F.struct(model.alias("model"), r.alias("layer_range"))).alias("sources"))
    )
    return F.struct(
        slices.alias("slices"), F.lit(merge_method).alias("merge_method"), F.lit(dtype).alias("dtype")
    )


def pruning_plans(blocks: DataFrame, n_layers: int, rule: str = "half_open") -> DataFrame:
    """One plan per best block (``model``, ``n``, ``block_start``, ``block_end``)."""
    plan = plan_slices(F.col("block_start"), F.col("block_end"), n_layers, F.col("model"), rule)
    return blocks.select("model", "n", "block_start", "block_end", plan.alias("plan"))


def slice_rows(plans: DataFrame) -> DataFrame:
    """A plan as rows, one per slice."""
    return plans.select(
        "model", "n", F.posexplode("plan.slices").alias("slice_idx", "slice"), "plan.merge_method", "plan.dtype"
    ).select(
        "model",
        "n",
        "slice_idx",
        F.col("slice.sources")[0]["layer_range"][0].alias("layer_from"),
        F.col("slice.sources")[0]["layer_range"][1].alias("layer_to"),
        "merge_method",
        "dtype",
    )
