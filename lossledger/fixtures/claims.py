"""The driver's order and line-item tables read as claims data.

Three frames, one per entity, hold the payload fields and envelope of every event as typed
columns. From them come Bronze-shaped frames (valid events only) and raw JSON lines with a
known share of faults. Every mapping is a plain column expression, so the same data can be
computed in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger import schemas
from lossledger.functions.tokens import Tokenizer
from lossledger.operators.settle import settled

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; its zone-less timestamps become UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


#: Bytes of a table's files for each task that makes its lines.
DEALT_BYTES = 4 << 20


def dealt(rows: DataFrame, scanned: DataFrame, *keys: str) -> DataFrame:
    """The rows that a table scan (joined with smaller tables) gives, dealt out by a hash of `keys`.

    A scan has no more tasks with rows than the files have row groups. What is made of a row (its line, the
    contract check) takes far longer than the shuffle of its few columns.
    """
    size = int(str(scanned._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, -(-size // DEALT_BYTES)), *keys)


def _dec(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def _padded(name: str, width: int = 10) -> Column:
    return F.lpad(F.col(name).cast("string"), width, "0")


def _pick(number: Column, *names: str) -> Column:
    """names[number] for a number from 0 to len(names) - 1."""
    chosen = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        chosen = F.when(number == i, names[i]).otherwise(chosen)
    return chosen


def _email(name: Column) -> Column:
    return F.concat(F.replace(name, F.lit("#"), F.lit(".")), F.lit("@Example.com"))


def _state(number: Column) -> Column:
    return F.concat(F.char(65 + number % 26), F.char(65 + (number * 7) % 26))


def _iso_day(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def policy_events(spark: SparkSession, sf_dir: str, *, spread: bool = False) -> DataFrame:
    """One policy version per order; with `spread`, not in the tasks of the table's scan (see `dealt`)."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    if spread:
        joined = dealt(joined, orders, "o_orderkey", "o_custkey", "o_orderdate")
    return joined.select(
        (F.col("o_orderkey") * 10).alias("fault_key"),
        F.struct(
            F.lit("orders").alias("source"),
            F.lit(0).cast("bigint").alias("block"),
            F.col("o_orderkey").alias("row"),
        ).alias("source_pos"),
        F.concat(F.lit("pol-"), _padded("o_orderkey")).alias("event_id"),
        F.when(F.col("o_orderstatus") == "F", "policy.created")
        .otherwise("policy.updated")
        .alias("event_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(1).cast("bigint").alias("event_version"),
        F.col("o_orderdate").alias("occurred_at"),
        F.concat(F.lit("policy-admin-"), (F.col("n_nationkey") % 3).cast("string")).alias("producer"),
        F.concat(F.lit("policy-"), _padded("o_custkey", 8)).alias("correlation_id"),
        F.col("o_orderdate").alias("ingested_at"),
        F.col("o_custkey").cast("string").alias("policy_id"),
        F.concat(F.lit("cus-"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        _email(F.col("c_name")).alias("customer_email"),
        F.lower("c_mktsegment").alias("line_of_business"),
        _state(F.col("n_nationkey")).alias("state"),
        _iso_day(F.col("o_orderdate")).alias("effective_date"),
        _iso_day(F.date_add("o_orderdate", 365)).alias("expiration_date"),
        F.col("c_acctbal").alias("annual_premium"),
        F.col("o_totalprice").alias("coverage_limit"),
        ((F.col("o_orderkey") % 4 + 1) * 500).cast("double").alias("deductible"),
        F.when(F.col("o_orderstatus") == "F", "active")
        .when(F.col("o_orderstatus") == "O", "cancelled")
        .otherwise("expired")
        .alias("status"),
    )


def claim_events(spark: SparkSession, sf_dir: str, *, spread: bool = False) -> DataFrame:
    """One claim version per line item; the claim is the order, the policy its customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if spread:
        joined = dealt(joined, lines, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    supplier = F.concat(F.lit("Claimant "), F.col("l_suppkey").cast("string"))
    reserve = _dec("l_extendedprice")
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fault_key"),
        F.struct(
            F.lit("lineitem").alias("source"),
            F.lit(0).cast("bigint").alias("block"),
            F.col("l_partkey").alias("row"),
        ).alias("source_pos"),
        F.concat(F.lit("clm-"), _padded("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("event_id"),
        F.when(F.col("l_linenumber") == 1, "claim.opened").otherwise("claim.updated").alias("event_type"),
        F.lit(1).cast("bigint").alias("event_version"),
        F.col("l_shipdate").alias("occurred_at"),
        F.concat(F.lit("claims-desk-"), (F.col("l_suppkey") % 4).cast("string")).alias("producer"),
        F.concat(F.lit("claim-"), _padded("l_orderkey")).alias("correlation_id"),
        F.col("l_shipdate").alias("ingested_at"),
        F.col("l_orderkey").cast("string").alias("claim_id"),
        F.col("o_custkey").cast("string").alias("policy_id"),
        supplier.alias("claimant_name"),
        F.concat(F.lit("Claimant."), F.col("l_suppkey").cast("string"), F.lit("@Example.com")).alias(
            "claimant_email"
        ),
        _iso_day(F.col("o_orderdate")).alias("loss_date"),
        F.concat(
            _iso_day(F.date_add("o_orderdate", (F.col("l_partkey") % 15).cast("int"))),
            F.lit("T00:00:00+00:00"),
        ).alias("reported_at"),
        _pick(
            F.col("l_linenumber") % 5,
            "hail",
            "burst_pipe",
            "rear_end",
            "break_in",
            "lightning",
        ).alias("claim_type"),
        _state(F.col("l_suppkey")).alias("state"),
        F.col("l_extendedprice").alias("reserve_amount"),
        (reserve * _dec("l_discount") * 10).cast("double").alias("paid_amount"),
        _pick(F.col("l_partkey") % 5, *schemas.CLAIM_STATUSES).alias("status"),
        F.concat(F.lit("desk-"), (F.col("l_suppkey") % 23).cast("string")).alias("adjuster_id"),
        (F.col("l_suppkey") % 5 + 1).alias("severity"),
        _pick(F.col("l_suppkey") % 4, "letter", "branch", "agent", "partner_api").alias("source_system"),
    )


def payment_events(spark: SparkSession, sf_dir: str, *, spread: bool = False) -> DataFrame:
    """One payment per line item."""
    lines = table(spark, sf_dir, "lineitem")
    if spread:
        lines = dealt(lines, lines, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fault_key"),
        F.struct(
            F.lit("lineitem").alias("source"),
            F.lit(0).cast("bigint").alias("block"),
            F.col("l_partkey").alias("row"),
        ).alias("source_pos"),
        F.concat(F.lit("pay-"), _padded("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("event_id"),
        F.lit("payment.issued").alias("event_type"),
        F.lit(1).cast("bigint").alias("event_version"),
        F.col("l_shipdate").alias("occurred_at"),
        F.concat(F.lit("treasury-"), F.col("l_linestatus")).alias("producer"),
        F.concat(F.lit("claim-"), _padded("l_orderkey")).alias("correlation_id"),
        F.col("l_shipdate").alias("ingested_at"),
        F.concat(F.lit("pmt-"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("payment_id"),
        F.col("l_orderkey").cast("string").alias("claim_id"),
        _iso_day(F.col("l_shipdate")).alias("payment_date"),
        (_dec("l_quantity") * _dec("l_tax") * 100).cast("double").alias("amount"),
        _pick(F.col("l_linenumber") % 4, "advance", "rest", "fee", "refund").alias("payment_type"),
        F.concat(F.lit("Payee "), F.col("l_suppkey").cast("string")).alias("payee_name"),
        F.when(F.col("l_returnflag") == "R", "void")
        .when(F.col("l_returnflag") == "A", "cleared")
        .otherwise("issued")
        .alias("payment_status"),
    )


EVENTS = {"policy": policy_events, "claim": claim_events, "payment": payment_events}

# The only contract rules the mapped tables break by themselves.
NATURAL_RULE = {"policy": "annual_premium > 0", "claim": "reserve_amount >= 0", "payment": "amount > 0"}


def bronze(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """Bronze as the ingest would leave it for the fault-free events of one entity."""
    tokens = Tokenizer.create(spark, allow_development_key=True)
    valid = EVENTS[entity](spark, sf_dir).where(NATURAL_RULE[entity])
    for field in schemas.PAYLOADS[entity]:
        if field.email:
            valid = valid.withColumn(field.name, F.lower(field.name))
    names = [f.name for f in schemas.PAYLOADS[entity]]
    return valid.select(
        *schemas.ENVELOPE_COLUMNS,
        *tokens.protect(names, schemas.PII_FIELDS),
        "source_pos",
        F.lit(entity).alias("entity"),
        F.to_date("occurred_at").alias("event_date"),
        F.lit("tables").alias("batch_id"),
    )


# Faults by residue of `fault_key`, first match wins: (divisor, residue, name).
FAULTS = (
    (100, 0, "first_key_dropped"),
    (101, 1, "unknown_key"),
    (103, 2, "negative_amount"),
    (107, 3, "truncated"),
    (109, 4, "no_offset"),
    (113, 5, "bad_status"),
    (127, 6, "short_id"),
)

_MONEY_FIELD = {"claim": "reserve_amount", "payment": "amount"}


def fault_of(key: Column, entity: str) -> Column:
    """Name of the injected fault, null for most records and for all policies."""
    if entity == "policy":
        return F.lit(None).cast("string")
    fault = F.lit(None).cast("string")
    for divisor, residue, name in reversed(FAULTS):
        fault = F.when(key % divisor == residue, name).otherwise(fault)
    return fault


def raw_lines(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """JSON lines (`value`) of one entity with its faults, and each line's `source_pos`."""
    df = EVENTS[entity](spark, sf_dir, spread=True).withColumn("fault", fault_of(F.col("fault_key"), entity))

    def broken(name: str) -> Column:
        return F.coalesce(F.col("fault") == name, F.lit(False))

    # to_json leaves out null fields, so a null drops the key.
    fields = []
    for i, spec in enumerate(schemas.PAYLOADS[entity]):
        col = F.col(spec.name)
        if i == 0:
            col = F.when(~broken("first_key_dropped"), col)
        if spec.name == _MONEY_FIELD.get(entity):
            col = F.when(broken("negative_amount"), -col - 1).otherwise(col)
        if entity == "claim" and spec.name == "status":
            col = F.when(broken("bad_status"), "pending").otherwise(col)
        fields.append(col.alias(spec.name))
    if entity == "payment":
        fields.append(F.when(broken("bad_status"), "x").alias("memo"))

    stamp = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss")
    line = F.to_json(
        F.struct(
            F.when(broken("short_id"), F.lit("short")).otherwise(F.col("event_id")).alias("event_id"),
            "event_type",
            "event_version",
            F.concat(stamp, F.when(broken("no_offset"), "").otherwise("Z")).alias("occurred_at"),
            "producer",
            "correlation_id",
            F.struct(*fields).alias("payload"),
            F.when(broken("unknown_key"), F.lit(True)).alias("unexpected"),
        )
    )
    lines = settled(df.select(line.alias("line"), broken("truncated").alias("cut"), "source_pos"))
    kept = F.when(F.col("cut"), F.left("line", F.length("line") - 2)).otherwise(F.col("line"))
    return settled(lines.select(kept.alias("value"), "source_pos"))


def all_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all three entities."""
    first, *rest = (raw_lines(spark, sf_dir, e) for e in schemas.ENTITIES)
    for other in rest:
        first = first.unionByName(other)
    return first


def feed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a feed of raw records, a month of mixed entities.

    Clicks are policies, purchases payments, views and signups claims. Errors are records
    that cannot be stored: cut off, not UTF-8, or without a customer id.
    """
    kind, key = F.col("event_type"), F.col("event_id").cast("string")
    day = _iso_day(F.col("ts"))
    fault = F.when(kind == "error", _pick(F.col("user_id") % 3, "contract", "json", "utf8")).otherwise("")
    policy = F.struct(
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("policy_id"),
        F.when(fault != "contract", F.concat(F.lit("C"), F.col("user_id").cast("string"))).alias("customer_id"),
        F.lit("Robin Example").alias("customer_name"),
        F.lit("Robin@Mail.Example").alias("customer_email"),
        F.lit("property").alias("line_of_business"),
        F.lit("NY").alias("state"),
        day.alias("effective_date"),
        day.alias("expiration_date"),
        (F.col("value") + 1).alias("annual_premium"),
        F.lit(1000.0).alias("coverage_limit"),
        F.lit(0).alias("deductible"),
        F.lit("active").alias("status"),
    )
    claim = F.struct(
        F.concat(F.lit("K"), key).alias("claim_id"),
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("policy_id"),
        F.lit("Robin Example").alias("claimant_name"),
        F.lit("Robin@Mail.Example").alias("claimant_email"),
        day.alias("loss_date"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("reported_at"),
        F.lit("hail").alias("claim_type"),
        F.lit("NY").alias("state"),
        F.col("value").alias("reserve_amount"),
        F.lit(0).alias("paid_amount"),
        F.lit("open").alias("status"),
        F.lit("desk-7").alias("adjuster_id"),
        (F.col("user_id") % 5 + 1).alias("severity"),
        F.lit("letter").alias("source_system"),
    )
    payment = F.struct(
        F.concat(F.lit("Y"), key).alias("payment_id"),
        F.concat(F.lit("K"), key).alias("claim_id"),
        day.alias("payment_date"),
        (F.col("value") + 1).alias("amount"),
        F.lit("refund").alias("payment_type"),
        F.lit("Robin Example").alias("payee_name"),
        F.lit("issued").alias("payment_status"),
    )

    def line(event_type: str, payload: Column) -> Column:
        return F.to_json(
            F.struct(
                F.concat(F.lit("feed-"), F.lpad(key, 12, "0")).alias("event_id"),
                F.lit(event_type).alias("event_type"),
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at"),
                F.concat(F.lit("feed-"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("correlation_id"),
                payload.alias("payload"),
            )
        )

    whole = (
        F.when(kind == "purchase", line("payment.issued", payment))
        .when(kind == "view", line("claim.opened", claim))
        .when(kind == "signup", line("claim.updated", claim))
        .otherwise(line("policy.created", policy))
    )
    position = F.struct(F.lit("events").alias("source"), F.lit(0).cast("bigint").alias("block"), F.col("event_id").alias("row"))
    events = table(spark, sf_dir, "events")
    feed = dealt(events, events, "event_id", "ts").select(
        whole.alias("line"), fault.alias("fault"), position.alias("source_pos")
    )
    line_of, fault_of_line = F.col("line"), F.col("fault")
    undecodable = F.concat(line_of.cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    value = (
        F.when(fault_of_line == "json", F.left(line_of, F.length(line_of) - 2))
        .when(fault_of_line == "utf8", undecodable)
        .otherwise(line_of)
    )
    return settled(settled(feed).select(value.alias("value"), "source_pos"))
