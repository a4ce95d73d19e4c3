"""Streaming ingest: every micro-batch goes through the batch ingest under a stable id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lossledger.functions.tokens import Tokenizer
from lossledger.lake import Lake
from lossledger.plans.ingest import ingest_batch
from lossledger.session import configure


def lines_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Lines of files as they arrive in a folder, at most `max_files` per micro-batch."""
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .text(folder)
        .select(
            "value",
            F.col("_metadata.file_path").alias("_source"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )


def _positioned(batch: DataFrame) -> DataFrame:
    """Add the row part of file positions, which only a batch frame can number."""
    if "source_pos" in batch.columns:
        return batch
    return batch.select(
        "value",
        F.struct(
            F.col("_source").alias("source"),
            F.col("_block").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("source_pos"),
    )


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps for a query in its checkpoint."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def start_ingest(
    records: DataFrame,
    lake: Lake,
    key: bytes | None,
    checkpoint: str,
    *,
    name: str,
    available_now: bool = False,
    allow_development_key: bool = False,
    **options: str,
) -> StreamingQuery:
    """Run the ingest on a stream of records (`lines_stream` or `sources.kafka.read_stream`).

    Offsets are committed after the batch is stored, so a crash replays the batch. Its id holds
    the query's own id, which lives in the checkpoint: a replay replaces what was stored, and a
    stream that starts over with a new checkpoint can't touch the batches of the old one. There
    is no watermark: late events are stored like all others and Silver orders by event time.
    """

    query_ids: list[str] = []

    def store(batch: DataFrame, number: int) -> None:
        spark = configure(batch.sparkSession)
        if not query_ids:
            query_ids.append(_query_id(spark, checkpoint))
        tokens = Tokenizer.create(spark, key, allow_development_key=allow_development_key)
        batch_id = f"stream-{name}-{query_ids[0]}-{number}"
        ingest_batch(spark, _positioned(batch), lake, batch_id, tokens, **options)

    writer = records.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(store)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
