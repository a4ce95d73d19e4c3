"""Bronze scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lossledger import schemas
from lossledger.commits import CommitLog

_PARTITIONS = [
    T.StructField("entity", T.StringType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("batch_id", T.StringType()),
]


def _scan(spark: SparkSession, root: str, schema: T.StructType, entity: str | None = None) -> DataFrame:
    """The folders that the commits name, of one entity or all."""
    folders = CommitLog(spark, root).folders(entity)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*folders).select(*schema.names)


def read_entity(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """One entity: only its folders are listed. The declared schema merges files by column name
    without reading footers."""
    if entity not in schemas.ENTITIES:
        raise ValueError(f"unknown entity {entity!r}")
    return _scan(spark, root, schemas.bronze_schema(entity), entity)


def envelopes(spark: SparkSession, root: str) -> DataFrame:
    """Envelope columns of all entities."""
    fields = [f for f in schemas.bronze_schema("policy") if f.name in schemas.ENVELOPE_COLUMNS]
    return _scan(spark, root, T.StructType([*fields, *_PARTITIONS]))
