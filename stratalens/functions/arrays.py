"""Padding, cutting and labelling of token arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IGNORED_LABEL = -100  # fixed value: label positions the loss skips


def truncate(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def pad_right(ids: Column, length: Column | int, value: int) -> Column:
    """``ids`` followed by ``value`` up to ``length``; longer arrays stay as they are."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(value).cast("int"), F.greatest(length - F.size(ids), F.lit(0))))


def ones(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def masked_labels(prompt_ids: Column, completion_ids: Column) -> Column:
    """Ignored marks over the prompt, then the completion ids."""
    return F.concat(F.array_repeat(F.lit(IGNORED_LABEL), F.size(prompt_ids)), completion_ids)
