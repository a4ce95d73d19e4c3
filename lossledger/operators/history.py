"""Validity intervals (type 2 history) that stay parallel when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A key is heavy above this share of all rows, so there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 1e-5
# Keys with fewer rows than this never need splitting.
HEAVY_MIN_ROWS = 1_000_000

_MINUTE_MICROS = 60 * 1_000_000


def heavy_keys(
    df: DataFrame, key: str, share: float = HEAVY_SHARE, min_rows: int = HEAVY_MIN_ROWS
) -> DataFrame:
    """Keys that hold more than `share` of the rows: never more than 1 / share keys."""
    total = df.agg(F.count("*").alias("n")).scalar()
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    floor = F.greatest(F.lit(min_rows).cast("double"), total.cast("double") * share)
    return counts.where(F.col("n").cast("double") > floor).select(key)


def with_next_instant(
    df: DataFrame,
    key: str,
    at: str,
    tie: str,
    out: str,
    *,
    weigh: DataFrame | None = None,
    share: float = HEAVY_SHARE,
    min_rows: int = HEAVY_MIN_ROWS,
) -> DataFrame:
    """Add `out`: the `at` of the next row of the same key in (at, tie) order, else null.

    Light keys use one window over the key. Rows of a heavy key are first reduced to their
    distinct instants, whose successors are found inside one minute and then from minute to
    minute: no task ever sorts more than the distinct microseconds of a minute or the
    minutes of a key, however many rows share the key or even the instant.

    `weigh` is the frame whose row counts decide which keys are heavy; passing the raw table
    avoids counting the result of an expensive plan.
    """
    found = heavy_keys(df if weigh is None else weigh, key, share, min_rows)
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, tie))
    if not found.take(1):  # every key fits in a task, so the frame is read once
        return df.withColumn(out, following)
    heavy = F.broadcast(found)
    light = df.join(heavy, key, "left_anti").withColumn(out, following)

    dense = df.join(heavy, key, "left_semi")
    instants = dense.groupBy(key, at).agg(F.max(tie).alias("_last"))
    minute = F.floor(F.unix_micros(at) / _MINUTE_MICROS)
    inside = Window.partitionBy(key, "_minute").orderBy(at)
    stepped = (
        instants.withColumn("_minute", minute)
        .withColumn("_next", F.lead(at).over(inside))
        .withColumn("_first", F.first(at).over(inside))
    )
    across = Window.partitionBy(key).orderBy("_minute")
    last_of_minute = stepped.where("_next is null").withColumn("_next", F.lead("_first").over(across))
    successors = (
        stepped.where("_next is not null")
        .unionByName(last_of_minute)
        .select(key, F.col(at).alias("_at"), "_last", "_next")
    )
    # Rows before the last of an instant are followed by another row of the same instant.
    right = successors.withColumnRenamed(key, "_key")
    split = dense.join(right, (F.col(key) == F.col("_key")) & (F.col(at) == F.col("_at")))
    split = split.withColumn(
        out, F.when(F.col(tie) == F.col("_last"), F.col("_next")).otherwise(F.col(at))
    )
    return light.unionByName(split.select(*light.columns))
