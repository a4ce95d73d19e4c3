"""Replays of an archive through a zone map: files outside the range are never opened.

The map has one row a file: least and greatest event time of its lines, its lines and those
without a readable, zoned time, and the size and change time it was built from. It is built once,
and `refresh` reads only files that are new or have changed. A range reads the files that overlap it and
any that the map doesn't know; the lines themselves are still checked, so a stale map can't lose one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lossledger.session import path_exists
from lossledger.sources.records import file_position, read_lines, records_between, timed

SCHEMA = "file string, size bigint, changed_at timestamp, first_at timestamp, last_at timestamp, lines bigint, unreadable bigint"


def archive_files(spark: SparkSession, archive: str) -> DataFrame:
    """(file, path, size, changed_at) of an archive, from its folder alone; `file` is encoded as in file metadata."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(archive).select(
        F.col("_metadata.file_path").alias("file"),
        "path",
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("changed_at"),
    )


def zones(spark: SparkSession, files: list[str]) -> DataFrame:
    """The zone map rows of some files."""
    lines = spark.read.text(files).select(
        "value",
        file_position().alias("source_pos"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("changed_at"),
    )
    known = F.col("_time").isNotNull() & F.col("_time.aware")
    at = F.when(known, F.col("_time.at"))
    return timed(lines).groupBy("file", "size", "changed_at").agg(
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.count("*").alias("lines"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("unreadable"),
    )


def read_zones(spark: SparkSession, index: str) -> DataFrame:
    """The newest row of each file."""
    if not path_exists(spark, f"{index}/*.parquet"):
        return spark.createDataFrame([], SCHEMA)
    newest = Window.partitionBy("file").orderBy(F.desc("changed_at"))
    rows = spark.read.schema(SCHEMA).parquet(index).withColumn("_rank", F.row_number().over(newest))
    return rows.where("_rank = 1").drop("_rank")


def refresh(spark: SparkSession, archive: str, index: str) -> list[str]:
    """Add the files that the map doesn't know as they are now; gives their paths."""
    now = archive_files(spark, archive)
    missing = now.join(read_zones(spark, index), ["file", "size", "changed_at"], "left_anti")
    paths = sorted(r["path"] for r in missing.select("path").collect())
    if paths:
        zones(spark, paths).coalesce(1).write.mode("append").parquet(index)
    return paths


def files_between(spark: SparkSession, archive: str, index: str, start: datetime, end: datetime) -> list[str]:
    """The files that may hold events of start <= occurred_at < end."""
    mapped = archive_files(spark, archive).join(read_zones(spark, index), ["file", "size", "changed_at"], "left")
    overlaps = (F.col("first_at") < F.lit(end)) & (F.col("last_at") >= F.lit(start))
    return sorted(r["path"] for r in mapped.where(F.col("lines").isNull() | overlaps).select("path").collect())


def read_archive(spark: SparkSession, archive: str, index: str, start: datetime, end: datetime) -> DataFrame:
    """The lines of an archive that fall into an event-time range, by way of its zone map."""
    files = files_between(spark, archive, index, start, end)
    lines = read_lines(spark, files) if files else read_lines(spark, archive).limit(0)
    return records_between(lines, start, end)
