"""A planning boundary for wide computed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, made: str | None = None) -> DataFrame:
    """The same rows, planned apart from the steps that follow.

    The optimizer rewrites later filters and projections in terms of the expressions below
    them and repeats them in every branch of a union. Wide columns that build on each other
    would multiply. It merges no projections across a generator, and moves no filter below one that
    isn't deterministic; columns that nobody reads are still left out below it. The column `made` comes out of
    the generator itself: the optimizer would trace a join key back through every expression behind it.
    """
    if made is not None:
        held = F.explode(F.array(F.struct(made, F.rand(0).alias("_rand")))).alias("_settled")
        return df.select("*", held).withColumn(made, F.col("_settled")[made]).drop("_settled")
    return df.select("*", F.explode(F.array(F.rand(0))).alias("_settled")).drop("_settled")
