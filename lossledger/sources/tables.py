"""Published Silver and Gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.lake import Lake
from lossledger.session import path_exists


class WarehouseMissing(RuntimeError):
    """Nothing has been published yet."""


def current_run(spark: SparkSession, lake: Lake) -> str:
    """Id of the run published last."""
    if not path_exists(spark, f"{lake.published}/*.json"):
        raise WarehouseMissing(f"no published run under {lake.published}: run the pipeline first")
    log = spark.read.schema("run_id string, published_at timestamp").json(lake.published)
    return log.agg(F.max_by("run_id", F.struct("published_at", "run_id"))).first()[0]


def read_table(
    spark: SparkSession, lake: Lake, schema: str, name: str, run_id: str | None = None
) -> DataFrame:
    """One table of a run, by default of the run published last."""
    path = lake.table(run_id or current_run(spark, lake), schema, name)
    if not path_exists(spark, path):
        raise WarehouseMissing(f"no table {schema}.{name} at {path}")
    return spark.read.parquet(path)
