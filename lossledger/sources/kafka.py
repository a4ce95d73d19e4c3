"""Message-topic source. Needs Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger import schemas

# Messages of a micro-batch; size it to what the cluster checks in a trigger interval.
BATCH_MESSAGES = 1_000_000


def topics(prefix: str) -> dict[str, str]:
    """Topic of each entity: `<prefix>.<entity>.events`."""
    return {entity: f"{prefix}.{entity}.events" for entity in schemas.ENTITIES}


def read_options(servers: str, prefix: str, batch_messages: int = BATCH_MESSAGES) -> dict[str, str]:
    """Options of the subscription: all topics from the earliest offset, bounded batches."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics(prefix).values()),
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": str(batch_messages),
    }


def messages(raw: DataFrame) -> DataFrame:
    """(`value`, `source_pos`) of frames with the connector's columns."""
    return raw.select(
        F.col("value").cast("string").alias("value"),
        F.struct(
            F.col("topic").alias("source"),
            F.col("partition").cast("bigint").alias("block"),
            F.col("offset").cast("bigint").alias("row"),
        ).alias("source_pos"),
    )


def read_stream(
    spark: SparkSession, servers: str, prefix: str, batch_messages: int = BATCH_MESSAGES
) -> DataFrame:
    options = read_options(servers, prefix, batch_messages)
    return messages(spark.readStream.format("kafka").options(**options).load())


def read_batch(spark: SparkSession, servers: str, prefix: str, max_messages: int | None = None) -> DataFrame:
    """What the topics hold now, in one batch; at most `max_messages` in all if given."""
    options = read_options(servers, prefix)
    del options["maxOffsetsPerTrigger"]
    found = messages(spark.read.format("kafka").options(**options).load())
    return found if max_messages is None else found.limit(max_messages)
