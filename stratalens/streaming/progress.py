"""Running and epoch loss of a growing training log, rows in any order, by keyed state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stratalens.operators.losses import RUN

#: The state store that keyed state with timers needs, and its setting.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches of a run that one state holds at most.
CHUNK = 1 << 18

_STATE = "next long, total double, seen long, valid long, waiting binary, losses binary"
_OUT = "batch_idx long, loss double, _sum double, _seen long, _valid long"


class RunningLoss(StatefulProcessor):
    """Emits the batches of a chunk in their order, each once all before it are there.

    State of a key: the next batch, sums so far, and the batches that came
    early. With a column of event times a timer waits for the missing ones:
    when the watermark passes the latest row, the state goes on behind
    the gap, and a batch that comes after all is left out.
    """

    def __init__(self, names: list[str], chunk: int, first: int, time: str | None):
        self.names, self.chunk, self.first, self.time = names, chunk, first, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def _load(self, start: int) -> tuple[int, float, int, int, np.ndarray, np.ndarray]:
        if not self.held.exists():
            return start, 0.0, 0, 0, np.zeros(0, np.int64), np.zeros(0)
        number, total, seen, valid, waiting, losses = self.held.get()
        return number, total, seen, valid, np.frombuffer(waiting, np.int64), np.frombuffer(losses)

    def _emit(self, key: tuple, state: tuple, skip_gap: bool) -> pd.DataFrame:
        number, total, seen, valid, waiting, losses = state
        ready = len(waiting) if skip_gap else int((waiting == number + np.arange(len(waiting))).cumprod().sum())
        own = losses[:ready]
        sums = total + np.cumsum(np.nan_to_num(own, nan=0.0))
        valids = valid + np.cumsum(~np.isnan(own))
        found = pd.DataFrame({
            **dict(zip(self.names, key)), "batch_idx": waiting[:ready], "loss": own, "_sum": sums, "_seen": seen + np.arange(1, ready + 1), "_valid": valids,
        })
        if ready:
            number, total, seen, valid = int(waiting[ready - 1]) + 1, float(sums[-1]), seen + ready, int(valids[-1])
        waiting, losses = waiting[ready:], losses[ready:]
        self.held.update((number, total, seen, valid, waiting.tobytes(), losses.tobytes()))
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))  # of one key: at most a chunk and what is repeated of it
        number, total, seen, valid, waiting, losses = self._load(max(int(key[-1]) * self.chunk, self.first))
        every = np.r_[waiting, frame["batch_idx"].to_numpy(np.int64)]
        waiting, at = np.unique(every, return_index=True)  # a repeated batch counts once
        losses = np.r_[losses, frame["loss"].to_numpy(float)][at]
        keep = waiting >= number
        state = number, total, seen, valid, waiting[keep], losses[keep]
        found = self._emit(key, state, skip_gap=False)
        if self.time is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if len(state[4]) > len(found):
                latest = pd.to_datetime(frame[self.time]).max()
                self.handle.registerTimer(int(latest.value // 1_000_000))
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._emit(key, self._load(self.first), skip_gap=True)

    def close(self) -> None:
        pass


def running_loss_stream(
    log: DataFrame, keys: Sequence[str] = RUN, chunk: int = CHUNK, first: int = 1, time: str | None = None
) -> DataFrame:
    """Rows of a streamed log (``keys``, batch_idx from ``first``, loss) in order within their chunk, with sums of the chunk.

    A run is cut by batch number, so a run with a third of all rows is many
    keys; ``settled`` adds the chunks up. Missing batches are waited for without
    end, or, if ``time`` names a column with a watermark, until that passes the
    rows behind them. The session must use the RocksDB state store.
    """
    cut = log.select(*keys, *([time] if time else []), "batch_idx", F.col("loss").cast("double").alias("loss"), F.floor(F.col("batch_idx") / chunk).alias("_chunk"))
    kinds = ", ".join(f"{key} {log.schema[key].dataType.simpleString()}" for key in keys)

    names = [*keys, "_chunk"]
    processor = RunningLoss(names, chunk, first, time)
    mode = "None" if time is None else "EventTime"
    return cut.groupBy(*names).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{kinds}, _chunk long, {_OUT}", outputMode="Append", timeMode=mode
    )


def store(stream: DataFrame, out: str, state: str) -> None:
    """Append all that has arrived since the last call with the same ``state`` folder; a repeated batch leaves one copy."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", state)
    query.trigger(availableNow=True).start().awaitTermination()


def settled(spark: SparkSession, out: str, schema, keys: Sequence[str] = RUN) -> tuple[DataFrame, DataFrame]:
    """Running losses and epoch losses from the stored rows; a batch waits for its chunk's, not for earlier chunks' batches."""
    rows = spark.read.schema(schema).parquet(out)
    last = F.max(F.struct("_seen", "_sum", "_valid")).alias("last")
    chunks = rows.groupBy(*keys, "_chunk").agg(last).select(*keys, "_chunk", "last.*")
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    before = chunks.select(
        *keys, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_sum_before"),
        F.coalesce(F.sum("_seen").over(earlier), F.lit(0)).alias("_seen_before"),
    )
    joined = rows.join(before, [*keys, "_chunk"])
    total, seen = F.col("_sum_before") + F.col("_sum"), F.col("_seen_before") + F.col("_seen")
    running = joined.select(*keys, "batch_idx", "loss", total.alias("loss_sum"), seen.alias("seen"), (total / seen).alias("running_loss"))
    sums = chunks.groupBy(*keys).agg(F.sum("_sum").alias("loss_sum"), F.sum("_seen").alias("batches"), F.sum("_valid").alias("valid_batches"))
    return running, sums.withColumn("average_loss", F.col("loss_sum") / F.nullif("batches", F.lit(0)))
