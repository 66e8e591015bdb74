"""Batched calls of a caller-supplied model: prompt to response, text to layer states."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def generate(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
    batch_size: int = 32,
    prompt: str = "prompt",
) -> DataFrame:
    """Add ``response`` and ``latency_ms``, the time of the call divided by its rows.

    ``make_predict_fn`` runs once per task, so a model is loaded once per task.
    """

    @F.pandas_udf("response string, started_at timestamp, latency_ms double")
    def call(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = make_predict_fn()
        for series in prompts:
            parts = []
            for at in range(0, len(series), batch_size):
                chunk = series.iloc[at : at + batch_size]
                started, clock = pd.Timestamp.now("UTC"), time.perf_counter()
                responses = list(predict(chunk.tolist()))
                spent = (time.perf_counter() - clock) * 1e3 / len(chunk)
                parts.append(pd.DataFrame({"response": responses, "started_at": started, "latency_ms": spent}))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["response", "started_at", "latency_ms"])

    # Catalyst would repeat the call for each field of the result; ``explode`` keeps it to one.
    called = df.withColumn("_call", F.explode(F.array(call(F.col(prompt)))))
    return called.select(*df.columns, "_call.response", "_call.started_at", "_call.latency_ms")


def hidden_states(
    df: DataFrame,
    make_states_fn: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[Sequence[float]]]]],
    batch_size: int = 32,
    text: str = "text",
) -> DataFrame:
    """Add ``layers``: for every text the last-token state of each layer, packed in one array."""

    @F.pandas_udf("array<array<float>>")
    def call(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        states = make_states_fn()
        for series in texts:
            found = []
            for at in range(0, len(series), batch_size):
                found.extend(states(series.iloc[at : at + batch_size].tolist()))
            yield pd.Series([[list(layer) for layer in layers] for layers in found], dtype=object)

    return df.withColumn("layers", call(F.col(text)))
