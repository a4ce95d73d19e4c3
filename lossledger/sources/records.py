"""Raw event records as (`value`, `source_pos`) frames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossledger import schemas
from lossledger.functions import variants
from lossledger.operators.contracts import parse, read_plain, usual_instant
from lossledger.operators.settle import settled
from lossledger.session import path_exists

def _position(source: Column, block: Column, row: Column) -> Column:
    return (
        F.struct(source.alias("source"), block.cast("bigint").alias("block"), row.cast("bigint").alias("row"))
        .cast(schemas.SOURCE_POS)
        .alias("source_pos")
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of the files at `path` (or a list of them), blank ones too, in a batch read.

    The position is the file, the split inside it and the row inside the task: it grows with
    the line number of a file however the file is split.
    """
    return spark.read.text(path).select("value", file_position())


def file_position() -> Column:
    """Position of a line in a batch read of files."""
    return _position(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )


def from_column(df: DataFrame, column: str, position: Column | None = None) -> DataFrame:
    """Records held in a text, binary, variant, struct or map column of any frame.

    Binary is read as UTF-8 and checked later; structured values are written as JSON.
    """
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.StructType, T.MapType, T.VariantType)):
        value = F.to_json(value)
    elif isinstance(kind, T.BinaryType):
        value = value.cast("string")
    elif not isinstance(kind, T.StringType):
        raise TypeError(f"cannot read event records from a {kind.simpleString()} column")
    if position is None:
        position = _position(F.lit(None).cast("string"), F.lit(None), F.monotonically_increasing_id())
    return df.select(value.alias("value"), position.alias("source_pos"))


def records_between(records: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Records with start <= occurred_at < end.

    Lines without a readable, zoned `occurred_at` belong to no range: the first ingest has
    quarantined them, and a replay must not do so again on each run (see `unreadable`).
    """
    if start.tzinfo is None or end.tzinfo is None:
        raise ValueError("start and end need a time zone")
    if start >= end:
        raise ValueError("start must be earlier than end")
    inside = (F.col("_time.at") >= F.lit(start)) & (F.col("_time.at") < F.lit(end))
    return timed(records).where(F.col("_time.aware") & inside).select(*records.columns)


def unreadable(records: DataFrame) -> DataFrame:
    """Records without a readable, zoned `occurred_at`: what no replayed range contains."""
    return timed(records).where(F.col("_time").isNull() | ~F.col("_time.aware")).select(*records.columns)


def timed(records: DataFrame) -> DataFrame:
    """Records with `_time`: the instant of `occurred_at` and whether it has a zone; null if unreadable."""
    at_once = F.when(F.col("_plain._broken").isNull(), usual_instant(F.col("_plain.occurred_at")))
    plain = settled(read_plain(records, "occurred_at:string").withColumn("_at_once", at_once))
    cell = F.try_variant_get("_document", "$.occurred_at", "variant")
    timed = parse(plain, F.col("_at_once").isNull()).withColumn("_cell", F.when(cell.isNotNull(), variants.cell(cell)))
    found = F.coalesce("_at_once", variants.instant(F.col("_cell.type"), F.col("_cell.text")))
    # Settled, because a filter on the time would otherwise read it again for each of its terms.
    return settled(timed.withColumn("_time", found)).drop("_plain", "_at_once")


def read_archive(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """The lines of an archive that fall into an event-time range."""
    return records_between(read_lines(spark, path), start, end)


def line_count(spark: SparkSession, path: str) -> int:
    """Number of lines at `path`, 0 when nothing is there."""
    return spark.read.text(path).count() if path_exists(spark, path) else 0
