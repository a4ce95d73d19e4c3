"""Message-topic sink. Needs Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lossledger.sources.kafka import topics

# Fixed values, producer settings: no duplicates from retries, all replicas acknowledge, small linger.
PRODUCER_OPTIONS = {
    "kafka.enable.idempotence": "true",
    "kafka.acks": "all",
    "kafka.compression.type": "zstd",
    "kafka.linger.ms": "20",
}


def to_messages(events: DataFrame, prefix: str) -> DataFrame:
    """`topic`, `key` and `value` of event rows that hold the envelope with its payload struct."""
    topic: Column = F.lit(None).cast("string")
    entity = F.split_part(F.col("event_type"), F.lit("."), F.lit(1))
    for name, target in topics(prefix).items():
        topic = F.when(entity == name, target).otherwise(topic)
    envelope = F.struct(
        "event_id", "event_type", "event_version", "occurred_at", "producer", "correlation_id", "payload"
    )
    # Explicit nulls are kept and times are ISO text in UTC, as readers of the topic expect.
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"}
    return events.select(
        topic.alias("topic"),
        F.col("correlation_id").cast("binary").alias("key"),
        F.to_json(envelope, options).cast("binary").alias("value"),
    )


def publish(events: DataFrame, servers: str, prefix: str) -> int:
    """Send every event; returns how many were sent."""
    sent = Observation("sent")
    messages = to_messages(events, prefix).observe(sent, F.count("*").alias("n"))
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .options(**PRODUCER_OPTIONS)
        .save()
    )
    return sent.get["n"]
