"""Samples with and without a readable image."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _read_urls(payloads: DataFrame) -> DataFrame:
    """Each url once, however many copies of its payload there are."""
    return payloads.where("payload is not null").select("url").distinct()


def with_payload(samples: DataFrame, payloads: DataFrame) -> DataFrame:
    return samples.join(_read_urls(payloads), "url", "left_semi")


def without_payload(samples: DataFrame, payloads: DataFrame) -> DataFrame:
    return samples.join(_read_urls(payloads), "url", "left_anti")
