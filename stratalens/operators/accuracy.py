"""Multiple-choice accuracy and the curve over pruned models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def match_predictions(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Predictions next to the truth of their item; an item with very many of them is split by the adaptive skew join."""
    return predictions.join(items.select("item_id", "truth"), "item_id")


def choice_accuracy(matched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions; an unparsed one (NULL) is wrong; NULL for no rows."""
    right = F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False)).cast("int")
    return matched.groupBy(*keys).agg(
        F.sum(right).alias("correct"), F.count("*").alias("total"), F.avg(right).alias("accuracy")
    )


def performance_curve(best: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Accuracy by number of removed layers; the unpruned model is the point ``n = 0``.

    A left join keeps that point, and any scored model without a best block, with NULL blocks.
    """
    blocks = best.select("model", "n", "block_start", "block_end")
    return (
        accuracy.select("model", "n", "accuracy")
        .join(blocks, ["model", "n"], "left")
        .select("model", "n", "block_start", "block_end", "accuracy")
    )
