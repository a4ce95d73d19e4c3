"""The registered queries: every operator of the package over the driver's whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import UTC, datetime
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger import schemas
from lossledger.fixtures import claims as fx
from lossledger.functions.tokens import KEY_VARIABLE, Tokenizer
from lossledger.commits import CommitLog
from lossledger.lake import Lake
from lossledger.operators import checks, contracts, dedup, ledger, rates
from lossledger.operators.keyed_state import StateStore
from lossledger.operators.stored_events import StoredEvents
from lossledger.plans import gold, incremental, ingest, monitoring, quality, serving, silver
from lossledger.plans.pipeline import TABLES, build_run, run_pipeline
from lossledger.session import configure, shared_dir, shuffles_removed
from lossledger.sinks.bronze import read_dead_letters, write_bronze
from lossledger.sinks.kafka import to_messages
from lossledger.sinks.tables import publish_run, register_tables, write_report
from lossledger.sources import archive
from lossledger.sources import bronze as bronze_source
from lossledger.sources import records as record_source
from lossledger.sources.tables import read_table
from lossledger.streaming.ingest import lines_stream, start_ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def _zoneless(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the SQL side has them."""
    stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


def query(fn: Query) -> Query:
    """Register a query under its function name."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return _zoneless(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return run


# --- Silver -----------------------------------------------------------------------------


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.stg_policies(fx.bronze(spark, sf_dir, "policy"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.stg_claims(fx.bronze(spark, sf_dir, "claim"))


def _payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.stg_payments(fx.bronze(spark, sf_dir, "payment"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.EVENTS["policy"](spark, sf_dir).where(fx.NATURAL_RULE["policy"])
    return silver.dim_policy_history(_policies(spark, sf_dir), weigh=raw)


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = silver.latest_policy(_policies(spark, sf_dir))
    return silver.fct_claims_current(_claims(spark, sf_dir), _payments(spark, sf_dir), current)


@query
def stg_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policies(spark, sf_dir)


@query
def stg_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir)


@query
def stg_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payments(spark, sf_dir)


@query
def dim_policy_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


@query
def dim_policy_history_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history with the heavy-key path taken by every policy of more than five versions."""
    return silver.dim_policy_history(_policies(spark, sf_dir), share=2e-4, min_rows=5)


@query
def dim_policy_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.dim_policy_current(_history(spark, sf_dir))


@query
def latest_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.latest_policy(_policies(spark, sf_dir))


@query
def latest_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.stored_latest_claim(StoredEvents.store(fx.bronze(spark, sf_dir, "claim"), silver.UNSTAGED))


@query
def payments_by_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.payments_by_claim(_payments(spark, sf_dir))


@query
def fct_claims_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fact; queries that read a few of its columns shuffle no more than those."""
    events = StoredEvents.store(fx.bronze(spark, sf_dir, "claim"), silver.UNSTAGED)
    current = silver.latest_policy(_policies(spark, sf_dir))
    return silver.stored_claims_current(events, _payments(spark, sf_dir), current)


# --- Gold and serving -------------------------------------------------------------------


@query
def claims_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.claims_kpis(_fact(spark, sf_dir))


@query
def daily_claim_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.daily_claim_metrics(_fact(spark, sf_dir))


@query
def high_risk_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.high_risk_claims(_fact(spark, sf_dir))


@query
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.kpis(gold.claims_kpis(_fact(spark, sf_dir)))


@query
def kpi_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.kpi_cards(gold.claims_kpis(_fact(spark, sf_dir)))


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.run_summary(gold.claims_kpis(_fact(spark, sf_dir)))


@query
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.work_queue(gold.high_risk_claims(_fact(spark, sf_dir)))


@query
def high_risk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.top_risk(gold.high_risk_claims(_fact(spark, sf_dir)))


@query
def attention_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.attention_list(gold.high_risk_claims(_fact(spark, sf_dir)))


@query
def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.daily_metrics(gold.daily_claim_metrics(_fact(spark, sf_dir)))


@query
def daily_metrics_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = gold.daily_claim_metrics(_fact(spark, sf_dir))
    return serving.daily_metrics(daily, state="bh", line_of_business="machinery", limit=5000)


@query
def lines_of_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.lines_of_business(gold.daily_claim_metrics(_fact(spark, sf_dir)))


@query
def volume_by_loss_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.volume_by_loss_date(gold.daily_claim_metrics(_fact(spark, sf_dir)))


@query
def volume_by_loss_date_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.volume_by_loss_date(gold.daily_claim_metrics(_fact(spark, sf_dir)), "household")


@query
def incurred_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.incurred_by_line(gold.daily_claim_metrics(_fact(spark, sf_dir)))


# --- Incremental ------------------------------------------------------------------------


def _dealt(bronze: DataFrame, batches: int, batch: int) -> DataFrame:
    """One of several batches, dealt by a hash of the event id: each has late events of all times."""
    return bronze.where(F.pmod(F.xxhash64("event_id"), F.lit(batches)) == batch)


@query
def history_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy history after five batches out of order, the last of them given twice."""
    store, raw = StateStore(spark, shared_dir(spark, "state")), fx.bronze(spark, sf_dir, "policy")
    for batch in (3, 0, 4, 1, 2, 2):
        incremental.update_history(store, silver.stg_policies(_dealt(raw, 5, batch)), f"b{batch}", buckets=16)
    return incremental.policy_history(store, _policies(spark, sf_dir), buckets=16)


@query
def daily_metrics_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metrics after three batches that correct each other's claims, while policies change too."""
    store = StateStore(spark, shared_dir(spark, "state"))
    bronze = {entity: fx.bronze(spark, sf_dir, entity) for entity in schemas.ENTITIES}
    for batch in range(3):
        claims, payments = (_dealt(bronze[e], 3, batch) for e in ("claim", "payment"))
        # Until the last batch some policies have not come, and others are older versions.
        policies = bronze["policy"] if batch == 2 else _dealt(bronze["policy"], 2, 0)
        current = silver.latest_policy(silver.stg_policies(policies))
        events = StoredEvents.store(claims, silver.UNSTAGED)
        incremental.update_claims(store, events, silver.stg_payments(payments), current, f"b{batch}", buckets=16)
    return incremental.daily_metrics(store)


# --- Quality ----------------------------------------------------------------------------


@query
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.not_null(_fact(spark, sf_dir), "line_of_business").select("claim_id", "policy_id")


@query
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unique(_history(spark, sf_dir), "policy_version_key")


@query
def dq_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.accepted_values(_payments(spark, sf_dir), "payment_status", ("issued", "cleared"))


@query
def dq_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.relationships(
        _fact(spark, sf_dir), "policy_id", silver.latest_policy(_policies(spark, sf_dir))
    )


@query
def dq_non_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.outside(_fact(spark, sf_dir), quality.NEGATIVE_MONEY, "claim_id")


@query
def dq_risk_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.outside(_fact(spark, sf_dir), quality.RISK_OUT_OF_RANGE, "claim_id")


def _unchecked_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact of claims that no contract has seen: some reserves are negative, some severities too."""
    severity = F.when(F.col("status") == "denied", F.col("severity") - 9).otherwise(F.col("severity"))
    reserve = F.when(F.col("severity") == 4, -F.col("reserve_amount") - 1).otherwise(F.col("reserve_amount"))
    claims = _claims(spark, sf_dir)
    spoilt = claims.withColumns({"reserve_amount": reserve.cast("decimal(18,2)"), "severity": severity.cast("int")})
    return silver.fct_claims_current(spoilt, _payments(spark, sf_dir), silver.latest_policy(_policies(spark, sf_dir)))


@query
def dq_non_negative_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.outside(_unchecked_fact(spark, sf_dir), quality.NEGATIVE_MONEY, "claim_id", "reserve_amount")


@query
def dq_risk_range_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.outside(_unchecked_fact(spark, sf_dir), quality.RISK_OUT_OF_RANGE, "claim_id")


@query
def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report written as JSON and read back, checks and metrics."""
    counted = _classified(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == contracts.REJECTED).alias("r")
    )
    source, rejected = counted.first()
    report = quality.slo_report(_fact(spark, sf_dir), F.lit(source), F.lit(rejected))
    path = shared_dir(spark, "report")
    write_report(report, path)
    return spark.read.schema(report.schema).json(path).select("status", "checks.*", "metrics.*")


def _built(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Silver and Gold written as a run."""
    bronze = {entity: fx.bronze(spark, sf_dir, entity) for entity in schemas.ENTITIES}
    return build_run(Lake(shared_dir(spark, "lake")), "check", bronze)


@query
def data_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.data_tests(_built(spark, sf_dir))


@query
def stored_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs read back from a stored run."""
    return _built(spark, sf_dir)["claims_kpis"]


@query
def slo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.claim_metrics(_fact(spark, sf_dir))


@query
def slo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _classified(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == contracts.REJECTED).alias("r")
    )
    source, rejected = counted.first()  # one row, as the ingest log gives it
    report = quality.slo_report(_fact(spark, sf_dir), F.lit(source), F.lit(rejected))
    return report.select("status", "checks.*", "metrics.*")


# --- Contracts, tokens and the ledger ---------------------------------------------------


def _checked(spark: SparkSession, sf_dir: str, mode: str = contracts.LAX) -> DataFrame:
    return contracts.check(fx.all_raw_lines(spark, sf_dir), mode=mode)


def _classified(spark: SparkSession, sf_dir: str, mode: str = contracts.LAX) -> DataFrame:
    return contracts.classify(_checked(spark, sf_dir, mode), F.lit(False))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where(F.col("outcome") == contracts.ACCEPTED)


def _split_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(F.col("outcome").alias("status"), "error_class", "entity").agg(F.count("*").alias("events"))


@query
def contract_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_counts(_classified(spark, sf_dir))


@query
def contract_strict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_counts(_classified(spark, sf_dir, contracts.STRICT))


@query
def contract_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, every seventh position with an event type that breaks its pattern."""
    spoilt = F.regexp_replace("value", r'"event_type":"([a-z]+)[.]', r'"event_type":"$1 ')
    lines = fx.all_raw_lines(spark, sf_dir)
    lines = lines.withColumn("value", F.when(F.col("source_pos.row") % 7 == 0, spoilt).otherwise(F.col("value")))
    return _split_counts(contracts.classify(contracts.check(lines), F.lit(False)))


@query
def dead_letter_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = _classified(spark, sf_dir).where(F.col("outcome") == contracts.REJECTED)
    return monitoring.dead_letter_triage(rejected)


@query
def accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir).select(
        "entity",
        "event_id",
        "event_type",
        "event_version",
        "occurred_at",
        "producer",
        F.to_date("occurred_at").alias("event_date"),
    )


@query
def accepted_claim_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = contracts.classify(contracts.check(fx.raw_lines(spark, sf_dir, "claim")), F.lit(False))
    return tagged.where(F.col("outcome") == contracts.ACCEPTED).select(
        "event_id",
        "claim_id",
        "policy_id",
        "claimant_email",
        "loss_date",
        "reported_at",
        "reserve_amount",
        "paid_amount",
        "status",
        "severity",
    )


@query
def version_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.version_drift(_accepted(spark, sf_dir))


@query
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _accepted(spark, sf_dir).withColumn("ingested_at", F.col("occurred_at"))
    return monitoring.freshness(events)


@query
def pii_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = Tokenizer.create(spark, allow_development_key=True)
    people = fx.policy_events(spark, sf_dir).select("customer_id", "customer_name", "customer_email").distinct()
    return people.select(*tokens.protect(people.columns, schemas.PII_FIELDS))


@query
def pii_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payees' tokens by the key of the environment, of the caller, and of neither."""
    payees = fx.payment_events(spark, sf_dir).select("payee_name").distinct()
    before = os.environ.get(KEY_VARIABLE)
    try:
        os.environ[KEY_VARIABLE] = "key of the environment"
        found = {"environment": Tokenizer.create(spark), "given": Tokenizer.create(spark, b"key of the caller")}
        del os.environ[KEY_VARIABLE]
        found["neither"] = Tokenizer.create(spark, allow_development_key=True)
    finally:
        if before is not None:
            os.environ[KEY_VARIABLE] = before
    tokens = [payees.select(F.lit(by).alias("key"), t.token(F.col("payee_name")).alias("token")) for by, t in found.items()]
    return tokens[0].unionByName(tokens[1]).unionByName(tokens[2])


@query
def pii_token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payees of payments joined by token with suppliers whose names differ in case and spaces."""
    tokens = Tokenizer.create(spark, allow_development_key=True)

    def person(key: str, spelling: str) -> F.Column:
        return tokens.token(F.format_string(spelling, F.col(key).cast("string"))).alias("claimant")

    paid = fx.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    paid = paid.select(person("l_suppkey", "Payee %s"), "n").groupBy("claimant").agg(F.sum("n").alias("payments"))
    known = fx.table(spark, sf_dir, "supplier").select(person("s_suppkey", "  PAYEE %s\n"))
    return paid.join(known.groupBy("claimant").agg(F.count("*").alias("claims")), "claimant")


def _earlier_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of an earlier batch: all policies and the claims of returned items."""
    returned = fx.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    claim_id = F.concat(
        F.lit("clm-"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit("-"), F.col("l_linenumber")
    )
    return fx.policy_events(spark, sf_dir).select("event_id").union(returned.select(claim_id.alias("event_id")))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by the shuffled way that a batch of any size takes.

    The batch isn't stored, so its ids are not taken out first: that would check every line twice.
    """
    return ingest.tag(_checked(spark, sf_dir), _earlier_ids(spark, sf_dir).distinct(), fits=False)


@query
def ledger_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = [
        fx.EVENTS[e](spark, sf_dir).select(F.lit(e).alias("entity"), "event_id", F.col("source_pos.row").alias("pos"))
        for e in schemas.ENTITIES
    ]
    batch = events[0].unionByName(events[1]).unionByName(events[2])
    known = dedup.known_ids(batch, _earlier_ids(spark, sf_dir), fits=False)
    return dedup.flag_known(batch, known, fits=False).where("not is_known").drop("is_known")


@query
def ledger_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes against a ledger; events and distinct ids differ by copies inside the batch."""
    valid_id = F.when(F.col("outcome") != contracts.REJECTED, F.col("event_id"))
    return (
        _tagged(spark, sf_dir)
        .groupBy(F.col("outcome").alias("status"))
        .agg(F.count("*").alias("events"), F.count_distinct(valid_id).alias("ids"))
    )


def _outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.batch_counts(_tagged(spark, sf_dir))


@query
def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.totals(_outcome_counts(spark, sf_dir))


@query
def accepted_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.accepted_by_entity(_outcome_counts(spark, sf_dir))


@query
def rejected_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.rejected_by_reason(_outcome_counts(spark, sf_dir))


@query
def duplicate_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.duplicate_total(_outcome_counts(spark, sf_dir))


@query
def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.last_event(fx.bronze(spark, sf_dir, "policy"))


# --- Sources and sinks ------------------------------------------------------------------


def _stored_lines(spark: SparkSession, sf_dir: str) -> str:
    path = shared_dir(spark, "lines")
    lines = fx.all_raw_lines(spark, sf_dir).select("value")
    with shuffles_removed(spark):
        lines.write.option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")
    return path


@query
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_lines(spark, sf_dir)
    return record_source.read_lines(spark, path).agg(F.count("*").alias("lines"))


@query
def backfill_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one year of an archive; unreadable lines are replayed too and rejected."""
    start, end = datetime(1996, 1, 1, tzinfo=UTC), datetime(1997, 1, 1, tzinfo=UTC)
    replayed = record_source.records_between(fx.all_raw_lines(spark, sf_dir), start, end)
    tagged = contracts.classify(contracts.check(replayed), F.lit(False))
    return (
        tagged.where(F.col("outcome") == contracts.ACCEPTED)
        .groupBy("entity")
        .agg(
            F.count("*").alias("events"),
            F.min("occurred_at").alias("first_at"),
            F.max("occurred_at").alias("last_at"),
        )
    )


@query
def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy records given as text, as bytes and as parsed values."""
    lines = fx.raw_lines(spark, sf_dir, "policy").withColumn("kind", F.col("source_pos.row") % 3)
    as_text = record_source.from_column(lines.where("kind = 0"), "value")
    in_bytes = lines.where("kind = 1").select(F.col("value").cast("binary").alias("value"))
    parsed = lines.where("kind = 2").select(F.parse_json("value").alias("value"))
    records = as_text.unionByName(record_source.from_column(in_bytes, "value"))
    records = records.unionByName(record_source.from_column(parsed, "value"))
    tagged = contracts.classify(contracts.check(records), F.lit(False))
    return tagged.groupBy(F.col("outcome").alias("status"), "error_class").agg(F.count("*").alias("events"))


@query
def kafka_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per topic and key."""
    events = fx.policy_events(spark, sf_dir)
    names = [f.name for f in schemas.PAYLOADS["policy"]]
    messages = to_messages(events.withColumn("payload", F.struct(*names)), "claims")
    return messages.groupBy("topic", F.col("key").cast("string").alias("key")).agg(F.count("*").alias("messages"))


@query
def kafka_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of all entities read back from their JSON: topic, id, time, producer and two payload fields."""
    parts = []
    for entity, (key, amount) in {"policy": ("policy_id", "annual_premium"), "claim": ("claim_id", "reserve_amount"), "payment": ("payment_id", "amount")}.items():
        events = fx.EVENTS[entity](spark, sf_dir, spread=True)
        names = [f.name for f in schemas.PAYLOADS[entity]]
        messages = to_messages(events.withColumn("payload", F.struct(*names)), "claims")
        shape = f"event_id string, event_version long, occurred_at timestamp, producer string, payload struct<{key}: string, {amount}: double>"
        body = F.from_json(F.col("value").cast("string"), shape)
        read = messages.select("topic", body.alias("v")).select("topic", "v.event_id", "v.event_version", "v.occurred_at", "v.producer", F.col(f"v.payload.{key}").alias("payload_key"), F.col(f"v.payload.{amount}").alias("amount"))
        parts.append(read)
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _partitions(spark: SparkSession, lake: Lake) -> DataFrame:
    stored = bronze_source.envelopes(spark, lake.bronze)
    return stored.groupBy("entity", "event_date").agg(F.count("*").alias("events"))


@query
def bronze_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event feed ingested as one batch; Bronze rows per entity and day."""
    return _partitions(spark, _stored_feed(spark, sf_dir))


def _stored_feed(spark: SparkSession, sf_dir: str) -> Lake:
    """A lake that holds the whole feed, ingested as one batch."""
    lake = Lake(shared_dir(spark, "lake"))
    tokens = Tokenizer.create(spark, allow_development_key=True)
    ingest.ingest_batch(spark, fx.feed_records(spark, sf_dir), lake, "batch-1", tokens)
    return lake


@query
def bronze_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's scan of Bronze, with the defaults of keys that the feed leaves out."""
    lake = _stored_feed(spark, sf_dir)
    scans = [
        bronze_source.read_entity(spark, lake.bronze, e)
        .groupBy("entity", "event_type", "event_version", "producer")
        .agg(F.count("*").alias("events"), F.min("occurred_at").alias("first_at"))
        for e in schemas.ENTITIES
    ]
    return scans[0].unionByName(scans[1]).unionByName(scans[2])


@query
def batch_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and accepted share of a stored batch."""
    metrics = spark.read.parquet(_stored_feed(spark, sf_dir).batch_metrics)
    return monitoring.throughput(metrics).select("source_rows", "accepted_share")


@query
def contract_strict_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed under the strict envelope, which has no defaults for the keys that it leaves out."""
    checked = contracts.check(fx.feed_records(spark, sf_dir), mode=contracts.STRICT)
    return _split_counts(contracts.classify(checked, F.lit(False)))


@query
def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a stored archive and of one that isn't there."""
    path = _stored_lines(spark, sf_dir)
    counted = [(name, record_source.line_count(spark, at)) for name, at in (("stored", path), ("absent", path + "-none"))]
    return spark.createDataFrame(counted, "archive string, lines bigint")


@query
def published_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs read by their published name and through the log of published runs."""
    lake = Lake(shared_dir(spark, "lake"))
    bronze = {entity: fx.bronze(spark, sf_dir, entity) for entity in schemas.ENTITIES}
    build_run(lake, "run-1", bronze)
    publish_run(spark, lake, "run-1")
    register_tables(spark, lake, "run-1", TABLES)
    by_name = spark.table("gold.claims_kpis").withColumn("reader", F.lit("name"))
    return by_name.unionByName(read_table(spark, lake, "gold", "claims_kpis").withColumn("reader", F.lit("log")))


@query
def rerun_replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch stored again from another input (fewer days, one entity, no rejects): what is left of both."""
    lake = Lake(shared_dir(spark, "lake"))
    tokens = Tokenizer.create(spark, allow_development_key=True)
    feed = fx.feed_records(spark, sf_dir)
    ingest.ingest_batch(spark, feed, lake, "batch-1", tokens)
    start, end = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 15, tzinfo=UTC)
    fewer = record_source.records_between(feed, start, end)
    fewer = fewer.where(F.contains("value", F.lit('"policy.created"')) & F.contains("value", F.lit('"customer_id"')))
    ingest.ingest_batch(spark, fewer, lake, "batch-1", tokens, replace=True)
    rejects = read_dead_letters(spark, lake.dead_letters).agg(F.count("*").alias("events"))
    gone = rejects.select(F.lit("dead letters").alias("entity"), F.lit(None).cast("date").alias("event_date"), "events")
    return _partitions(spark, lake).unionByName(gone)


@query
def stored_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's rejects read back from the dead letters: class, named fields, and whether the text is whole."""
    lake = _stored_feed(spark, sf_dir)
    letters = read_dead_letters(spark, lake.dead_letters)
    return letters.groupBy(
        "error_class",
        F.array_join(F.array_sort(F.array_distinct(F.col("errors.field"))), ",").alias("fields"),
        F.col("raw_base64").isNotNull().alias("has_bytes"),
        (F.length("raw") > 0).alias("has_text"),
    ).agg(F.count("*").alias("events"))


@query
def backfill_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks of a stored archive replayed twice: the second run accepts and rejects nothing new."""
    lake, folder = Lake(shared_dir(spark, "lake")), shared_dir(spark, "archive")
    fx.feed_records(spark, sf_dir).select("value").write.text(folder)
    tokens = Tokenizer.create(spark, allow_development_key=True)
    start, end = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 15, tzinfo=UTC)
    rows = []
    for run in (1, 2):
        done = ingest.backfill(spark, folder, start, end, lake, tokens)
        rows.append((run, done.accepted, done.duplicates))
    stored = spark.createDataFrame(rows, "run int, accepted bigint, duplicates bigint")
    events = bronze_source.envelopes(spark, lake.bronze).agg(F.count("*").alias("stored"))
    total = events.first()["stored"]
    return stored.withColumn("stored", F.lit(total))


@query
def archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored archive of one file a day, a day and a half of it by its zone map: files opened, events found."""
    folder, index = shared_dir(spark, "archive"), shared_dir(spark, "zones")
    feed = fx.feed_records(spark, sf_dir).select("value")
    day = F.coalesce(F.regexp_extract("value", r'"occurred_at":"(\d{4}-\d\d-\d\d)', 1), F.lit(""))
    feed.withColumn("day", day).repartition(8, "day").write.partitionBy("day").text(folder)
    archive.refresh(spark, folder, index)
    start, end = datetime(2024, 1, 9, tzinfo=UTC), datetime(2024, 1, 10, 12, tzinfo=UTC)
    opened = archive.files_between(spark, folder, index, start, end)
    days = len({name.split("/day=")[1].split("/")[0] for name in opened})
    found = archive.read_archive(spark, folder, index, start, end)
    return found.agg(F.count("*").alias("events")).withColumn("days_opened", F.lit(days))


@query
def replay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event feed ingested twice: the second run finds its accepted events in the ledger."""
    lake = Lake(shared_dir(spark, "lake"))
    tokens = Tokenizer.create(spark, allow_development_key=True)
    for run in (1, 2):
        ingest.ingest_batch(spark, fx.feed_records(spark, sf_dir), lake, f"run-{run}", tokens)
    logged = spark.read.parquet(lake.batch_metrics)
    run_of = F.split_part("batch_id", F.lit("-"), F.lit(2)).cast("int")
    return logged.select(run_of.alias("run"), "accepted", "rejected", "duplicates")


@query
def ledger_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's ids in twelve batches, each with the ids of the one before: new and known ids, and runs left."""
    lake = Lake(shared_dir(spark, "lake"))
    log = CommitLog(spark, lake.bronze)
    events = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("key"))
    rows = []
    for batch in range(12):
        part = events.where((F.col("key") % 12).isin(batch, batch - 1))
        new, known = ledger.acknowledge(part.select(F.col("key").cast("string").alias("event_id")), log, lake.ledger, f"b{batch}")
        rows.append((batch, new, known, len(log.latest().runs)))
    return spark.createDataFrame(rows, "batch int, new_ids bigint, known_ids bigint, runs int")


def _kept(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back by each step that needs them."""
    path = shared_dir(df.sparkSession, "kept")
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _commit_bronze(spark: SparkSession, lake: Lake, frames: dict[str, DataFrame], batch_id: str) -> None:
    """Put finished Bronze rows into a lake as one commit, filed by year to keep the folders few."""
    log = CommitLog(spark, lake.bronze)
    attempt = f"a-{batch_id}"
    for entity, rows in frames.items():
        filed = rows.withColumns({"batch_id": F.lit(batch_id), "event_date": F.trunc("event_date", "year")})
        write_bronze(filed, lake.bronze, entity, attempt)
    base = log.latest()
    folders = [{"entity": e, "days": []} for e in frames]
    if not log.commit(base, runs=list(base.runs), dead=list(base.dead), batch_id=batch_id, attempt=attempt, folders=folders):
        raise RuntimeError("another writer in a lake of this query's own")


@query
def gate_keeps_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two gated runs: claims of known policies pass; with the claims of unknown ones added, the gate
    refuses the run, and readers keep the first. Of a policy's events at one instant the last counts."""
    lake = Lake(shared_dir(spark, "lake"))
    lines = _stored_lines(spark, sf_dir)
    bronze = {entity: fx.bronze(spark, sf_dir, entity) for entity in schemas.ENTITIES}
    last = bronze["policy"].groupBy("policy_id", "occurred_at").agg(F.max("event_id").alias("event_id")).select("event_id")
    bronze["policy"] = bronze["policy"].join(last, "event_id", "left_semi")
    known = _kept(bronze["policy"].select("policy_id").distinct())
    sound = bronze["claim"].join(known, "policy_id", "left_semi")
    unsound = bronze["claim"].join(known, "policy_id", "left_anti")
    found = []
    for run, frames in (("run-1", bronze | {"claim": sound}), ("run-2", {"claim": unsound})):
        _commit_bronze(spark, lake, frames, run)
        try:
            status = run_pipeline(spark, lake, source=lines, run_id=run).status
        except quality.QualityGateError:
            status = "refused"
        kpis = read_table(spark, lake, "gold", "claims_kpis").select("total_claims", "total_incurred")
        found.append(kpis.select(F.lit(run).alias("run"), F.lit(status).alias("status"), "*"))
    return found[0].unionByName(found[1])


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event feed, undecodable lines too, as a folder of files, ingested by the streaming job."""
    lake = Lake(shared_dir(spark, "lake"))
    source = shared_dir(spark, "feed")
    fx.feed_records(spark, sf_dir).select("value").write.text(source)
    running = start_ingest(
        lines_stream(spark, source, max_files=1000),
        lake,
        None,
        shared_dir(spark, "checkpoint"),
        name="lines",
        available_now=True,
        allow_development_key=True,
    )
    running.awaitTermination()
    return _partitions(spark, lake)


@query
def stream_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed in no order of time, over several micro-batches: late events land where ordered ones do."""
    lake = Lake(shared_dir(spark, "lake"))
    source = shared_dir(spark, "feed")
    fx.feed_records(spark, sf_dir).select("value").repartition(4, F.xxhash64("value")).write.text(source)
    running = start_ingest(
        lines_stream(spark, source, max_files=2),
        lake,
        None,
        shared_dir(spark, "checkpoint"),
        name="permuted",
        available_now=True,
        allow_development_key=True,
    )
    running.awaitTermination()
    return _partitions(spark, lake)


# --- Monitoring -------------------------------------------------------------------------


def _ingest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a log of ingest outcomes and batch seconds."""
    is_error = F.col("event_type") == "error"
    entity = F.when(F.col("event_type") == "click", "policy").when(F.col("event_type") == "purchase", "payment")
    classes = F.array(*map(F.lit, (contracts.CONTRACT_ERROR, contracts.JSON_ERROR, contracts.DECODE_ERROR)))
    return fx.table(spark, sf_dir, "events").select(
        "ts",
        (F.col("value") / 100).alias("seconds"),
        F.when(is_error, contracts.REJECTED).otherwise(contracts.ACCEPTED).alias("outcome"),
        F.when(~is_error, F.coalesce(entity, F.lit("claim"))).alias("entity"),
        F.when(is_error, classes[(F.col("user_id") % 3).cast("int")]).alias("error_class"),
    )


@query
def event_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.accepted_rate(_ingest_log(spark, sf_dir))


@query
def rejected_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.rejected_rate(_ingest_log(spark, sf_dir))


@query
def p95_batch_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monitoring.latency_p95(_ingest_log(spark, sf_dir), "ts", "seconds")
    return found.withColumn("latency_seconds", F.round("latency_seconds", 9))


@query
def p95_latency_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of the log, and whether the sketched quantile lies within 2 % of the rank asked for."""
    log = _ingest_log(spark, sf_dir).select("ts", (F.col("seconds") * 1000).alias("seconds"))  # far above any bucket
    found = rates.sliding_latency_sketch(log, "ts", "seconds")
    steps = F.explode(F.sequence(F.lit(1), F.lit(rates.RANGE_MINUTES)))
    seen = log.select("seconds", F.date_trunc("minute", "ts").alias("minute"), steps.alias("step"))
    seen = seen.select("seconds", F.timestamp_micros(F.unix_micros("minute") + F.col("step") * 60_000_000).alias("range_end"))
    ranked = found.join(seen, "range_end").groupBy("range_end", "batches").agg(
        F.count_if(F.col("seconds") < F.col("latency_seconds")).alias("below"),
        F.count_if(F.col("seconds") <= F.col("latency_seconds")).alias("upto"),
    )
    near = (F.col("below") <= 0.97 * F.col("batches")) & (F.col("upto") >= 0.93 * F.col("batches"))
    return ranked.select("range_end", "batches", near.alias("within"))


@query
def event_rate_restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted rate from four batches of the log in no order of time, one of them given twice."""
    store = StateStore(spark, shared_dir(spark, "state"))
    log = _ingest_log(spark, sf_dir).where(F.col("outcome") == contracts.ACCEPTED)
    part = F.pmod(F.xxhash64("ts"), F.lit(4))
    for batch in (2, 0, 3, 3, 1):
        incremental.update_rates(store, log.where(part == batch), "ts", "entity", f"b{batch}")
    return incremental.published_rates(store, "entity")


@query
def outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters kept over three batches of the log, one of them given twice."""
    store = StateStore(spark, shared_dir(spark, "state"))
    log = _ingest_log(spark, sf_dir)
    for batch in (0, 1, 1, 2):
        part = log.where(F.pmod(F.xxhash64("ts"), F.lit(3)) == batch)
        counts = part.groupBy("outcome", "entity", "error_class").agg(F.count("*").alias("rows"))
        incremental.update_counters(store, counts, f"b{batch}")
    return incremental.counters(store)
