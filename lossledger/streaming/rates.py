"""Streaming form of the monitoring rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lossledger.operators.keyed_state import StateStore
from lossledger.operators.rates import RANGE_MINUTES
from lossledger.plans import incremental


def sliding_rate(
    stream: DataFrame, at: str, keys: list[str], minutes: int = RANGE_MINUTES, late: str = "10 minutes"
) -> DataFrame:
    """Rows per second over sliding ranges; a range is final `late` after its end."""
    counted = (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, f"{minutes} minutes", "1 minute"), *keys)
        .agg(F.count("*").alias("events"))
    )
    return counted.select(
        F.col("window.end").alias("range_end"),
        *keys,
        "events",
        (F.col("events") / F.lit(float(minutes * 60))).alias("per_second"),
    )


def restating_rate(
    stream: DataFrame, state: str, checkpoint: str, at: str, key: str, *, name: str, available_now: bool = False
) -> StreamingQuery:
    """Keep the ranges below `state` up to date from a stream of log rows, without a limit on lateness.

    Each micro-batch is added once, under its number and the `name`; a restart from the checkpoint
    repeats the last one without effect. `state` belongs to one checkpoint. Read the ranges with
    `plans.incremental.published_rates`.
    """

    def add(batch: DataFrame, number: int) -> None:
        store = StateStore(batch.sparkSession, state)
        incremental.update_rates(store, batch, at, key, f"{name}-{number}")

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(add)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
