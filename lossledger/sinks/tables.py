"""Silver and Gold tables of one run, and the log of published runs."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.lake import Lake
from lossledger.session import shuffles_removed


def write_table(df: DataFrame, lake: Lake, run_id: str, schema: str, name: str) -> DataFrame:
    """Write a table of a run and return it as read back, so that later steps start there."""
    path = lake.table(run_id, schema, name)
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def publish_run(spark: SparkSession, lake: Lake, run_id: str) -> None:
    """Make a finished run the current one. The log only grows; readers take its last row."""
    row = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(datetime.now(UTC)).alias("published_at"))
    row.coalesce(1).write.mode("append").json(lake.published)


def register_views(frames: dict[str, DataFrame]) -> None:
    """Register staging frames as temporary views."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def register_tables(spark: SparkSession, lake: Lake, run_id: str, names: dict[str, list[str]]) -> None:
    """Name the tables of a run in the catalog as `<schema>.<table>`, schema names verbatim."""
    for schema, tables in names.items():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {schema}.{name}")
            spark.catalog.createTable(f"{schema}.{name}", path=lake.table(run_id, schema, name), source="parquet")


def write_report(report: DataFrame, path: str) -> None:
    """Write the one-row quality report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def report_text(report: DataFrame) -> str:
    """The one-row quality report as indented JSON."""
    return json.dumps(json.loads(report.toJSON().first()), indent=2)
