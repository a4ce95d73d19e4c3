"""Latest-record and already-seen operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ids of one batch may be broadcast up to this measured size.
BROADCAST_BYTES = 128 * 1024 * 1024
_ROW_OVERHEAD = 48  # hash table and row header per id


def latest_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each `key` in `order`.

    The filter on the row number lets Spark keep one row per key in every map task before
    the shuffle, so a key with very many copies costs no more than any other.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def newest_copy() -> list[Column]:
    """Order of the copies of an event id: last ingested first; the source position settles equal times."""
    return [F.desc("ingested_at"), F.desc_nulls_last("source_pos"), F.desc_nulls_last("batch_id")]


def latest_event(bronze: DataFrame) -> DataFrame:
    """Last ingested copy of each event id."""
    return latest_by(bronze, "event_id", newest_copy())


def ids_fit(batch: DataFrame) -> bool:
    """Whether the event ids of a batch are measured small enough to broadcast."""
    size = batch.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("event_id")), F.lit(0))).first()
    return size[1] + size[0] * _ROW_OVERHEAD <= BROADCAST_BYTES


def known_ids(batch_ids: DataFrame, ledger_ids: DataFrame, fits: bool) -> DataFrame:
    """Those ids of a batch that the ledger holds, once each.

    A batch whose ids fit (see `ids_fit`) is broadcast against the ledger scan, so the ledger
    is read in place and never shuffled. Beyond that both sides are shuffled on the id.
    """
    ids = batch_ids.select("event_id").distinct()
    if fits:
        ids = F.broadcast(ids)
    return ledger_ids.select("event_id").join(ids, "event_id", "left_semi").distinct()


def flag_known(batch: DataFrame, known: DataFrame, fits: bool, flag: str = "is_known") -> DataFrame:
    """Add a boolean that says whether the event id was acknowledged before.

    `known` are the batch's known ids, once each; without `fits` other ids may be among them.
    """
    hits = known.select("event_id", F.lit(True).alias(flag))
    if fits:  # `known` is a subset of the batch's ids
        hits = F.broadcast(hits)
        return batch.join(hits, "event_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    # Rows without an id can't be known; a shuffle on the id alone would gather all of them in one task. A
    # hash of their other columns spreads them, so the batch is computed once and not once for each kind.
    # Of records the text and its place are enough, so that columns nobody reads need not be computed.
    record = [c for c in ("value", "source_pos") if c in batch.columns]
    hashed = record or [c for c, kind in batch.dtypes if "variant" not in kind and "map<" not in kind]
    spread = F.when(F.col("event_id").isNull(), F.xxhash64(*hashed)).otherwise(F.lit(0).cast("bigint"))
    keyed = hits.withColumn("_spread", F.lit(0).cast("bigint"))
    flagged = batch.withColumn("_spread", spread).join(keyed, ["event_id", "_spread"], "left").drop("_spread")
    return flagged.select(*batch.columns, F.coalesce(flag, F.lit(False)).alias(flag))
