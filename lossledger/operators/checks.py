"""Data tests. Each check gives the failing rows (or keys); an empty result passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; nulls do not count."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("occurrences"))
    return counted.where("occurrences > 1")


def accepted_values(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Values outside the list with their number of rows; null passes."""
    return df.where(~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("occurrences"))


def relationships(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Child keys without a parent and the number of their rows.

    The child is reduced to one row per key before the join, so a key shared by very many
    rows is joined once.
    """
    keys = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("occurrences"))
    parents = parent.select(F.col(parent_key or key).alias(key))
    return keys.join(parents, key, "left_anti")


def outside(df: DataFrame, condition: str, *columns: str) -> DataFrame:
    """Rows that meet a condition no row should meet."""
    return df.where(condition).select(*columns)
