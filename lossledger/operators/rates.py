"""Sliding-window rates and histogram quantiles for ingest monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_MINUTES = 5

# Upper bounds of the latency buckets in seconds; slower batches fall past the last.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def _over_range(per_minute: DataFrame, keys: list[str], measures: list[str], minutes: int) -> DataFrame:
    """Sum per-minute rows into the sliding ranges they belong to, one range per minute."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(minutes)))
    moved = per_minute.withColumn("_step", steps).withColumn(
        "range_end", F.timestamp_micros(F.unix_micros("_minute") + F.col("_step") * 60_000_000)
    )
    return moved.groupBy("range_end", *keys).agg(*[F.sum(m).alias(m) for m in measures])


def range_counts(df: DataFrame, at: str, keys: list[str], minutes: int = RANGE_MINUTES) -> DataFrame:
    """Rows in the `minutes` before each full minute, per key.

    Rows are counted per minute first, so only one row per minute and key is spread over the
    ranges and shuffled.
    """
    per_minute = df.groupBy(F.date_trunc("minute", at).alias("_minute"), *keys).agg(F.count("*").alias("events"))
    return _over_range(per_minute, keys, ["events"], minutes)


def sliding_rate(df: DataFrame, at: str, keys: list[str], minutes: int = RANGE_MINUTES) -> DataFrame:
    """Rows per second over the `minutes` before each full minute, per key."""
    return per_second(range_counts(df, at, keys, minutes), minutes)


def per_second(ranges: DataFrame, minutes: int = RANGE_MINUTES) -> DataFrame:
    return ranges.withColumn("per_second", F.col("events") / F.lit(float(minutes * 60)))


def quantile_from_buckets(q: float, bounds: tuple[float, ...], counts: list[Column]) -> Column:
    """Quantile of cumulative bucket counts, interpolated inside the bucket.

    `counts` holds one cumulative count per bound, then the total. Ranks past the last bound
    give the last bound.
    """
    total = counts[-1].cast("double")
    rank = total * q
    result = F.lit(bounds[-1])
    lower = [0.0, *bounds[:-1]]
    before = [F.lit(0), *counts[:-2]]
    for low, high, below, upto in reversed(list(zip(lower, bounds, before, counts[:-1], strict=True))):
        inside = low + (high - low) * (rank - below) / F.nullif(upto - below, F.lit(0))
        result = F.when(upto >= rank, inside).otherwise(result)
    return F.when(total > 0, result)


def sliding_latency(
    df: DataFrame,
    at: str,
    seconds: str,
    q: float = 0.95,
    minutes: int = RANGE_MINUTES,
    bounds: tuple[float, ...] = LATENCY_BOUNDS,
) -> DataFrame:
    """Quantile of batch latency over the `minutes` before each full minute.

    Only bucket counts are kept per minute, so any number of batches merges exactly. A quantile
    never exceeds the last of `bounds`: choose them above the batch times to be expected.
    """
    names = [f"_le_{i}" for i in range(len(bounds))]
    buckets = [F.count_if(F.col(seconds) <= b).alias(n) for b, n in zip(bounds, names, strict=True)]
    per_minute = df.groupBy(F.date_trunc("minute", at).alias("_minute")).agg(*buckets, F.count(seconds).alias("batches"))
    ranges = _over_range(per_minute, [], [*names, "batches"], minutes)
    counts = [F.col(n) for n in [*names, "batches"]]
    return ranges.select(
        "range_end", "batches", quantile_from_buckets(q, bounds, counts).alias("latency_seconds")
    )


#: Values a sketch keeps a level: quantiles are within about 0.7 % of the rank asked for.
SKETCH_SIZE = 400


def sliding_latency_sketch(
    df: DataFrame, at: str, seconds: str, q: float = 0.95, minutes: int = RANGE_MINUTES, size: int = SKETCH_SIZE
) -> DataFrame:
    """Quantile of batch latency over the `minutes` before each full minute, without a ceiling.

    One quantile sketch (KLL) a minute, of a size that doesn't depend on the rows, is spread over the
    ranges and merged; the result is one of the latencies seen, whatever their scale.
    """
    per_minute = df.groupBy(F.date_trunc("minute", at).alias("_minute")).agg(
        F.kll_sketch_agg_double(F.col(seconds).cast("double"), F.lit(size)).alias("_sketch"), F.count(seconds).alias("batches")
    )
    steps = F.explode(F.sequence(F.lit(1), F.lit(minutes)))
    moved = per_minute.where("batches > 0").withColumn("_step", steps)
    end = F.timestamp_micros(F.unix_micros("_minute") + F.col("_step") * 60_000_000)
    merged = moved.groupBy(end.alias("range_end")).agg(
        F.sum("batches").alias("batches"), F.kll_merge_agg_double("_sketch", F.lit(size)).alias("_sketch")
    )
    return merged.select("range_end", "batches", F.kll_sketch_get_quantile_double("_sketch", F.lit(q)).alias("latency_seconds"))
