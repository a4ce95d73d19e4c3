from __future__ import annotations

import hashlib
import hmac
import random
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal

import pytest
from conftest import event, lines
from pyspark.sql import functions as F

from lossledger import schemas
from lossledger.functions.numbers import money, round_half_up, share
from lossledger.functions.tokens import Tokenizer, token_key
from lossledger.operators import checks
from lossledger.operators.history import heavy_keys, with_next_instant
from lossledger.operators.rates import LATENCY_BOUNDS, sliding_latency, sliding_rate
from lossledger.plans import gold, ingest, quality, serving, silver
from lossledger.plans.pipeline import TABLES, run_pipeline
from lossledger.sinks.kafka import to_messages
from lossledger.sinks.tables import register_tables
from lossledger.sources import kafka
from lossledger.sources.tables import WarehouseMissing, current_run, read_table
from lossledger.streaming import rates as stream_rates

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def expected_token(value: str, key: bytes = b"a key of the tests") -> str:
    return "tok_" + hmac.new(key, value.strip().lower().encode(), hashlib.sha256).hexdigest()[:24]


def test_tokens_equal_hmac_and_ignore_case_and_outer_space(spark):
    values = ["Robin.Q@Mail.Example", " robin.q@mail.example ", "", "　Ärger \x1c", "a\nb\n"]
    for key in (b"a key of the tests", b"k" * 64, b"long" * 40):
        tokens = Tokenizer.create(spark, key)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        found = [r[0] for r in df.orderBy("i").select(tokens.token("v")).collect()]
        assert found == [expected_token(v, key) for v in values]


def test_key_stays_out_of_plans_and_defaults_are_refused(spark, monkeypatch):
    tokens = Tokenizer.create(spark, b"very-secret-key-value")
    plan = spark.range(1).select(tokens.token(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "very-secret" not in plan and "5C" * 8 not in plan.upper() and "36" * 8 not in plan
    monkeypatch.delenv("LOSSLEDGER_TOKEN_KEY", raising=False)
    with pytest.raises(ValueError, match="key"):
        token_key()
    assert token_key(b"", allow_development_key=True) == b"development-only-key"


def test_money_rounding(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (10.0,), (-1.5,)], "x double")
    assert [r[0] for r in df.select(money("x")).collect()] == [Decimal(v) for v in ("1.00", "2.68", "10.00", "-1.50")]
    row = spark.range(1).select(share(F.lit(1), F.lit(0)), share(F.lit(1), F.lit(4)), round_half_up(F.lit(0.12345), 4))
    assert tuple(row.first())[:2] == (0.0, 0.25)


def bronze_frame(spark, tokens, entity, *changes):
    """Bronze rows from events checked by the contract; later rows arrive later."""
    records = [event(entity, **c) for c in changes]
    from lossledger.operators import contracts

    tagged = contracts.classify(contracts.check(lines(spark, *records)), F.lit(False))
    return ingest.bronze_rows(tagged, entity, tokens, "b", F.lit(T0)).cache()


def test_staging_keeps_the_last_copy_of_an_event(spark, tokens):
    bronze = bronze_frame(spark, tokens, "payment", {"amount": 1.0}, {"amount": 2.5}, {"event_id": "event-0002"})
    rows = silver.stg_payments(bronze).orderBy("event_id").collect()
    assert [(r["event_id"], r["amount"]) for r in rows] == [
        ("event-0001", Decimal("2.50")),
        ("event-0002", Decimal("10.50")),
    ]
    assert rows[0]["payment_date"] == date(2025, 3, 1)


def claim(event_id, minutes=0, **changes):
    stamp = at(minutes).isoformat()
    return {"event_id": event_id, "envelope": {"occurred_at": stamp}, **changes}


def test_fact_measures_and_risk_terms(spark, tokens):
    claims = silver.stg_claims(
        bronze_frame(
            spark,
            tokens,
            "claim",
            claim("event-0001", 0, status="open"),
            claim("event-0002", 5, status="closed", paid_amount=6000),  # newer state of k-1, paid above reserve
            claim("event-0003", 5, claim_id="k-2", severity=5, source_system="partner_api",
                  reserve_amount=50000, reported_at="2025-02-08T00:00:00Z"),
            claim("event-0004", 5, claim_id="k-3", severity=5, source_system="partner_api",
                  reserve_amount=50000.01, reported_at="2025-02-09T00:00:00Z"),
            claim("event-0005", 5, claim_id="k-4", policy_id="nobody", reserve_amount=900000),
        )
    )
    payments = silver.stg_payments(
        bronze_frame(
            spark,
            tokens,
            "payment",
            {"event_id": "event-0011", "amount": 7000, "payment_status": "issued"},
            {"event_id": "event-0012", "amount": 500, "payment_status": "void"},
            {"event_id": "event-0013", "claim_id": "k-2", "payment_status": "void"},
            {"event_id": "event-0014", "claim_id": "no-claim"},
        )
    )
    policies = silver.stg_policies(bronze_frame(spark, tokens, "policy", {"coverage_limit": 100000}))
    fact = silver.fct_claims_current(claims, payments, silver.latest_policy(policies)).cache()
    rows = {r["claim_id"]: r for r in fact.collect()}
    assert set(rows) == {"k-1", "k-2", "k-3", "k-4"}
    k1 = rows["k-1"]
    assert (k1["status"], k1["paid_amount"], k1["outstanding_reserve"]) == ("closed", Decimal(7000), Decimal(0))
    assert (k1["total_incurred"], k1["payment_count"], k1["risk_score"]) == (Decimal(7000), 1, 45)
    assert (rows["k-2"]["payment_count"], rows["k-2"]["cleared_payment_amount"]) == (0, Decimal(0))
    assert (rows["k-2"]["reporting_delay_days"], rows["k-2"]["risk_score"]) == (7, 80)  # half the limit is not above it
    assert (rows["k-3"]["reporting_delay_days"], rows["k-3"]["risk_score"]) == (8, 100)  # 105 is capped
    assert (rows["k-4"]["line_of_business"], rows["k-4"]["risk_score"]) == (None, 45)

    kpis = gold.claims_kpis(fact).first()
    assert (kpis["total_claims"], kpis["open_claims"], kpis["high_risk_claims"]) == (4, 3, 2)
    daily = gold.daily_claim_metrics(fact).cache()
    assert serving.lines_of_business(daily).collect() == [("All",), ("property",)]
    assert sum(r["claim_count"] for r in serving.volume_by_loss_date(daily).collect()) == 4
    assert [r[0] for r in serving.incurred_by_line(daily).collect()] == ["property"]
    queue = gold.high_risk_claims(fact)
    assert [r["claim_id"] for r in serving.top_risk(queue, 1).collect()] == ["k-3"]
    assert serving.daily_metrics(daily, state="ny", line_of_business="property").count() == 1
    assert serving.daily_metrics(daily, state="", limit=1).count() == 1
    for bad in (0, 501, True, "5"):
        with pytest.raises(ValueError):
            serving.top_risk(queue, bad)
    with pytest.raises(ValueError):
        serving.daily_metrics(daily, limit=5001)
    with pytest.raises(ValueError):
        serving.daily_metrics(daily, state="NYC")

    parents = spark.createDataFrame([("p-1",)], "policy_id string")
    assert checks.relationships(fact, "policy_id", parents).collect() == [("nobody", 1)]
    report = quality.slo_report(fact, F.lit(100), F.lit(2)).first()
    assert report["status"] == "fail" and not report["checks"]["referential_integrity"]
    assert report["checks"]["rejection_rate_within_slo"] and report["metrics"]["rejection_rate"] == 0.02
    clean = quality.slo_report(fact.where("claim_id <> 'k-4'"), F.lit(0), F.lit(0)).first()
    assert clean["status"] == "pass" and clean["metrics"]["total_claims"] == 3


def brute_next(rows):
    ordered = sorted(rows)
    following = {}
    for this, after in zip(ordered, [*ordered[1:], None], strict=True):
        following[this] = after[1] if after and after[0] == this[0] else None
    return following


def test_next_instant_of_heavy_and_light_keys_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aaaaaabc"), at(rng.randint(0, 90) / 7), f"e{i:04}") for i in range(400)]
    df = spark.createDataFrame([(k, t, e) for k, t, e in rows], "k string, t timestamp, e string")
    expected = brute_next(rows)
    for share_, least in ((0.0, 100), (0.0, 0), (1.0, 10**9)):
        found = with_next_instant(df, "k", "t", "e", "nxt", share=share_, min_rows=least)
        got = {r["e"]: r["nxt"].replace(tzinfo=UTC) if r["nxt"] else None for r in found.collect()}
        assert got == {e: n for (_, _, e), n in expected.items()}
    assert [r[0] for r in heavy_keys(df, "k", 0.5, 10).collect()] == ["a"]


def test_history_intervals_are_contiguous_with_one_current_version(spark, tokens):
    changes = [claim(f"event-{i:04}", i // 2 * 60, policy_id=f"p-{i % 2}") for i in range(8)]
    for c in changes:
        c.pop("status", None)
    changes.append(claim("event-0099", 0, policy_id="p-0"))  # a second version at one instant
    policies = silver.stg_policies(bronze_frame(spark, tokens, "policy", *changes))
    history = silver.dim_policy_history(policies).cache()
    by_policy: dict[str, list] = {}
    for r in history.orderBy("policy_id", "valid_from", F.asc_nulls_last("valid_to")).collect():
        by_policy.setdefault(r["policy_id"], []).append(r)
    for versions in by_policy.values():
        assert sum(v["is_current"] for v in versions) == 1 and versions[-1]["valid_to"] is None
        for this, after in zip(versions, versions[1:], strict=False):
            assert this["valid_to"] == after["valid_from"]
    key = hashlib.md5(b"p-1|2025-01-01 00:00:00+00").hexdigest()
    assert by_policy["p-1"][0]["policy_version_key"] == key
    assert checks.unique(history, "policy_version_key").count() == 1  # versions of one instant share a key
    current = silver.dim_policy_current(history)
    assert current.exceptAll(silver.latest_policy(policies)).count() == 0 and current.count() == 2


def test_rates_count_five_minutes_and_stream_agrees(spark, tmp_path):
    rows = [(at(0.5), "policy"), (at(1.2), "policy"), (at(5.9), "policy"), (at(40), "claim")]
    df = spark.createDataFrame(rows, "ts timestamp, entity string")
    found = {(r["range_end"], r["entity"]): r["events"] for r in sliding_rate(df, "ts", ["entity"]).collect()}
    naive = {k: t.replace(tzinfo=None) for k, t in (("five", at(5)), ("six", at(6)), ("ten", at(10)))}
    assert found[naive["five"], "policy"] == 2 and found[naive["six"], "policy"] == 2 and found[naive["ten"], "policy"] == 1
    path = str(tmp_path / "log")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    query = (
        stream_rates.sliding_rate(stream, "ts", ["entity"])
        .writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    streamed = {(r["range_end"], r["entity"]): r["events"] for r in spark.table("rates").collect()}
    assert streamed == found


def test_latency_quantile_is_interpolated_in_its_bucket(spark):
    df = spark.createDataFrame([(at(0), 0.3)] * 90 + [(at(0), 0.9)] * 10 + [(at(60), 99.0)], "ts timestamp, s double")
    rows = {r["range_end"]: r for r in sliding_latency(df, "ts", "s").collect()}
    first = rows[at(1).replace(tzinfo=None)]
    assert first["batches"] == 100 and abs(first["latency_seconds"] - 0.875) < 1e-9
    assert rows[at(61).replace(tzinfo=None)]["latency_seconds"] == LATENCY_BOUNDS[-1]


def test_topic_messages_and_options(spark):
    assert kafka.read_options("h:1", "claims")["subscribe"] == "claims.policy.events,claims.claim.events,claims.payment.events"
    row = spark.createDataFrame(
        [("event-0001", "claim.opened", 1, T0, "unit", "corr-0001", ("k-1",))],
        "event_id string, event_type string, event_version int, occurred_at timestamp, producer string, "
        "correlation_id string, payload struct<claim_id:string>",
    )
    sent = to_messages(row, "claims").first()
    assert (sent["topic"], bytes(sent["key"])) == ("claims.claim.events", b"corr-0001")
    assert b'"payload":{"claim_id":"k-1"}' in bytes(sent["value"]) and b" " not in bytes(sent["value"])
    assert b'"occurred_at":"2025-01-01T00:00:00' in bytes(sent["value"])


def test_pipeline_publishes_only_runs_that_pass(spark, lake, tokens):
    with pytest.raises(WarehouseMissing):
        current_run(spark, lake)
    good = [event("policy"), event("claim", "event-0002"), event("payment", "event-0003")]
    ingest.ingest_batch(spark, lines(spark, *good), lake, "b1", tokens)
    report = run_pipeline(spark, lake, run_id="r1")
    assert report.published and report.status == "pass" and current_run(spark, lake) == "r1"
    assert read_table(spark, lake, "gold", "claims_kpis").first()["total_claims"] == 1
    register_tables(spark, lake, "r1", TABLES)
    assert spark.table("silver.fct_claims_current").count() == 1
    orphan = event("claim", "event-0004", claim_id="k-9", policy_id="nobody")
    ingest.ingest_batch(spark, lines(spark, orphan), lake, "b2", tokens)
    with pytest.raises(quality.QualityGateError, match="relationships"):
        run_pipeline(spark, lake, run_id="r2")
    assert current_run(spark, lake) == "r1"


def test_bronze_columns_match_the_declared_schema():
    for entity in schemas.ENTITIES:
        declared = schemas.bronze_schema(entity).names
        assert declared == [*schemas.bronze_columns(entity), *schemas.PARTITION_COLUMNS]
        assert not set(schemas.PII_FIELDS) & set(declared)
