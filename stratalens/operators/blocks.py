"""Distances between layers, per block of consecutive layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from stratalens.functions.vectors import last_positions_kernel, pack_kernel, pair_totals_kernel


def drop_embedding_state(states: DataFrame) -> DataFrame:
    """Remove entry 0 (the embedding output) and count layers from 0."""
    return states.where("layer > 0").withColumn("layer", F.col("layer") - 1)


def last_token_state(states: DataFrame, keys: Sequence[str] = ("sample_id", "layer")) -> DataFrame:
    """State at the highest position with mask 1; fails for a sample without one.

    Each Arrow batch is reduced to one state per key before anything is sorted
    or shuffled, so a sample with very many positions stays small; only what is
    left is aggregated.
    """
    pos = F.when(F.col("mask") == 1, F.col("pos")).cast("int")
    marked = states.select(*keys, pos.alias("pos"), "v")
    last = marked.mapInArrow(last_positions_kernel(list(keys)), marked.schema)
    picked = last.groupBy(*keys).agg(F.max("pos").alias("pos"), F.max_by("v", "pos").alias("v"))
    return picked.withColumn(
        "pos",
        F.when(F.col("pos").isNotNull(), F.col("pos")).otherwise(
            F.raise_error(F.lit("a sample has no position with mask 1")).cast("int")
        ),
    )


def samples_without_token(states: DataFrame) -> DataFrame:
    """Samples whose mask is 0 everywhere."""
    return states.groupBy("sample_id").agg(F.max("mask").alias("mask")).where("mask = 0").select("sample_id")


def pack_layers(states: DataFrame, n_layers: int) -> DataFrame:
    """One row per sample with ``layers``, an array of ``n_layers`` states; a missing one is NULL.

    There is one row per sample and layer, so nothing can be merged before the
    shuffle: the vectors move once, are sorted once, and a kernel puts the
    sorted stream together.
    """
    layers = T.StructField("layers", T.ArrayType(states.schema["v"].dataType))
    ordered = states.select("sample_id", F.col("layer").cast("int").alias("layer"), "v").repartition("sample_id")
    ordered = ordered.sortWithinPartitions("sample_id", "layer")
    return ordered.mapInArrow(pack_kernel(n_layers), T.StructType([states.schema["sample_id"], layers]))


def pack_stored_layers(states: DataFrame, n_layers: int) -> DataFrame:
    """As ``pack_layers``, for a table in buckets by sample: vectors stay in the task that reads them.

    A sample's states are gathered by an aggregation, whose demand for rows by
    sample the buckets meet. Two states of one sample and layer are an error.
    """
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("layer").cast("int"), "v")))
    gathered = states.groupBy("sample_id").agg(entries.alias("_of"))
    numbers = F.sequence(F.lit(0), F.lit(n_layers - 1))
    return gathered.select("sample_id", F.transform(numbers, lambda layer: F.try_element_at("_of", layer)).alias("layers"))


def pair_layers(states: DataFrame, n: int) -> DataFrame:
    """State of layer ``l`` with that of ``l + n``, same sample, one row per pair."""
    low = states.select("sample_id", F.col("layer").alias("low_layer"), F.col("v").alias("low_v"))
    high = states.select("sample_id", (F.col("layer") - n).alias("low_layer"), F.col("v").alias("high_v"))
    return low.join(high, ["sample_id", "low_layer"])


_TOTALS = [
    T.StructField("n", T.IntegerType()),
    T.StructField("block_start", T.IntegerType()),
    T.StructField("total", T.DoubleType()),
    T.StructField("pairs", T.LongType()),
]


def block_distances(packed: DataFrame, n: int | None = None, group: str | None = None) -> DataFrame:
    """Mean angular distance per block, for one ``n`` or all, optionally per ``group``.

    All pairs of a sample come from its one packed row, so vectors are shuffled
    once (to pack them) whatever the number of blocks; the second shuffle
    carries sums only.
    """
    keys = [group] if group else []
    schema = T.StructType([*(T.StructField(key, T.LongType()) for key in keys), *_TOTALS])
    totals = packed.select(*keys, "layers").mapInArrow(pair_totals_kernel(n, group), schema)
    return (
        totals.groupBy(*keys, "n", "block_start")
        .agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
        .select(
            *keys,
            "n",
            "block_start",
            (F.col("block_start") + F.col("n")).alias("block_end"),
            (F.col("total") / F.col("pairs")).alias("average_distance"),
        )
    )


def batch_block_distance(packed: DataFrame, batches: DataFrame, n: int | None = None) -> DataFrame:
    """Mean distance over each batch, per block. ``batches`` maps samples to batches."""
    placed = packed.join(batches.select("sample_id", "batch_id"), "sample_id")
    return block_distances(placed, n, group="batch_id")


def best_block(distances: DataFrame, keys: Sequence[str] = ("n",)) -> DataFrame:
    """Per ``n`` the block with the smallest mean; the first one on ties, NaN never."""
    scored = distances.where(~F.isnan("average_distance"))
    rank = F.struct("average_distance", "block_start")
    return (
        scored.groupBy(*keys)
        .agg(F.min(rank).alias("best"))
        .select(
            *keys,
            F.col("best.block_start").alias("block_start"),
            (F.col("best.block_start") + F.col("n")).alias("block_end"),
            F.col("best.average_distance").alias("average_distance"),
        )
    )


def min_distance(distances: DataFrame) -> DataFrame:
    """Per ``n`` the smallest mean, its 0-based layer, and all means in layer order; NaN propagates."""
    rank = F.struct("average_distance", "block_start")
    means = F.array_sort(F.collect_list(F.struct("block_start", "average_distance")))  # at most one per layer
    nan = F.max(F.isnan("average_distance"))
    found = distances.groupBy("n").agg(F.min(rank).alias("least"), means.alias("means"), nan.alias("nan"))
    return found.select(
        "n",
        F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("least.average_distance")).alias("min_distance"),
        (F.col("least.block_start") - 1).alias("layer_idx"),
        F.transform("means", lambda m: m["average_distance"]).alias("mean_distances"),
    )


def distance_matrix(distances: DataFrame, n_values: Sequence[int], axis: str = "start") -> DataFrame:
    """One column per ``n``; rows are block starts, or ``block_end - 1`` with ``axis='end'``."""
    row = {"start": F.col("block_start"), "end": F.col("block_end") - 1}[axis]
    matrix = (
        distances.groupBy(row.cast("int").alias("layer"))
        .pivot("n", list(n_values))
        .agg(F.first("average_distance"))
    )
    return matrix.select("layer", *[F.col(f"`{n}`").alias(f"n_{n}") for n in n_values])
