from __future__ import annotations

import json

import pytest
from conftest import event, lines
from pyspark.sql import functions as F

from lossledger import schemas
from lossledger.operators import contracts


def judge(spark, *records, mode=contracts.LAX):
    tagged = contracts.classify(contracts.check(lines(spark, *records), mode=mode), F.lit(False))
    return tagged.orderBy("source_pos").collect()


def with_key(drop=None, **changes):
    record = event("policy")
    if drop:
        del record[drop]
    return {**record, **changes}


REJECTS = {
    "unknown envelope key": (with_key(unexpected=True), "unexpected"),
    "unknown payload key": (event("payment", memo="x"), "memo"),
    "missing payload key": (event("policy", drop="policy_id"), "policy_id"),
    "missing envelope key": (with_key(drop="correlation_id"), "correlation_id"),
    "missing payload": (with_key(drop="payload"), "payload"),
    "payload is a list": (with_key(payload=[1]), "payload"),
    "short id": (with_key(event_id="short"), "event_id"),
    "bad type": (with_key(event_type="policy.Created"), "event_type"),
    "newline in type": (with_key(event_type="policy.created\n"), "event_type"),
    "other entity": (with_key(event_type="quote.created"), "event_type"),
    "version 0": (with_key(event_version=0), "event_version"),
    "version 1.5": (with_key(event_version=1.5), "event_version"),
    "null producer": (with_key(producer=None), "producer"),
    "naive time": (with_key(occurred_at="2025-03-01T10:00:00"), "occurred_at"),
    "no such time": (with_key(occurred_at="2025-02-30T10:00:00Z"), "occurred_at"),
    "number for text": (event("policy", customer_id=5), "customer_id"),
    "null text": (event("policy", customer_id=None), "customer_id"),
    "state length": (event("policy", state="NYC"), "state"),
    "email": (event("policy", customer_email="nobody"), "customer_email"),
    "zero premium": (event("policy", annual_premium=0), "annual_premium"),
    "negative deductible": (event("policy", deductible=-1), "deductible"),
    "nan premium": (event("policy", annual_premium="nan"), "annual_premium"),
    "status case": (event("policy", status="Active"), "status"),
    "day form": (event("policy", effective_date="2025-1-3"), "effective_date"),
    "no such day": (event("policy", effective_date="2025-02-30"), "effective_date"),
    "day with time": (event("policy", effective_date="2025-01-03T01:00:00"), "effective_date"),
    "claim status": (event("claim", status="pending"), "status"),
    "severity 6": (event("claim", severity=6), "severity"),
    "severity 0": (event("claim", severity=0), "severity"),
    "negative reserve": (event("claim", reserve_amount=-0.01), "reserve_amount"),
    "hour 24": (event("claim", reported_at="2025-01-03T24:00:00Z"), "reported_at"),
    "negative amount": (event("payment", amount=-10), "amount"),
    "zero amount": (event("payment", amount=0), "amount"),
}


def test_rejects_name_the_offending_field(spark):
    rows = judge(spark, *[r for r, _ in REJECTS.values()])
    for (name, (_, field)), row in zip(REJECTS.items(), rows, strict=True):
        assert row["outcome"] == contracts.REJECTED, name
        assert row["error_class"] == contracts.CONTRACT_ERROR, name
        assert [e["field"] for e in row["errors"]] == [field], name
        assert field in row["reason"], name


def test_valid_events_of_every_entity_are_accepted(spark):
    rows = judge(spark, *[event(e, f"event-{e}") for e in ("policy", "claim", "payment")])
    assert [r["outcome"] for r in rows] == [contracts.ACCEPTED] * 3
    assert [r["entity"] for r in rows] == ["policy", "claim", "payment"]
    assert rows[0]["customer_email"] == "robin@mail.example"
    assert rows[0]["annual_premium"] == 1200.5 and rows[0]["coverage_limit"] == 100000.0
    assert rows[1]["reported_at"] == "2025-02-03T00:00:00+00:00"
    assert rows[1]["severity"] == 3


def test_records_that_are_not_one_json_document(spark):
    good = json.dumps(event("policy"))
    bad = ["", " ", "{", good + " x", good + good, good[:-2], good + "], 1", "﻿" + good]
    rows = judge(spark, *bad, b"\xff" + good.encode(), "[1]", "null", '"text"')
    assert [r["error_class"] for r in rows[: len(bad)]] == [contracts.JSON_ERROR] * len(bad)
    assert rows[len(bad)]["error_class"] == contracts.DECODE_ERROR
    assert [r["error_class"] for r in rows[len(bad) + 1 :]] == [contracts.CONTRACT_ERROR] * 3


def test_last_of_equal_keys_wins_and_key_order_is_free(spark):
    record = event("policy")
    twice = json.dumps(record)[:-1] + ', "producer": "second"}'
    turned = json.dumps(dict(reversed(list(record.items()))))
    rows = judge(spark, twice, turned)
    assert [r["outcome"] for r in rows] == [contracts.ACCEPTED] * 2
    assert rows[0]["producer"] == "second"


def test_defaults_apply_to_absent_keys_only(spark):
    bare = with_key(drop="producer")
    del bare["event_version"]
    rows = judge(spark, bare, with_key(producer=""), with_key(event_version=None))
    assert (rows[0]["event_version"], rows[0]["producer"]) == (1, "unnamed-producer")
    assert rows[1]["outcome"] == contracts.ACCEPTED
    assert rows[2]["outcome"] == contracts.REJECTED


NUMBERS = {
    "12.5": 12.5, " 12.5 ": 12.5, "1e3": 1000.0, "1_000.5": 1000.5, ".5": 0.5, "5.": 5.0, "+5": 5.0,
    "\t1\n": 1.0, "inf": float("inf"), "abc": None, "": None, "1__0": None, "_1": None, "1_": None,
    "0x1": None, "1d": None, "12.5f": None,
}


def test_lenient_numbers(spark):
    values = [*NUMBERS, True, 7]
    rows = judge(spark, *[event("payment", f"event-{i:04}", amount=v) for i, v in enumerate(values)])
    assert [r["amount"] for r in rows] == [*NUMBERS.values(), 1.0, 7.0]
    fits = [r["amount"] is not None and r["amount"] <= schemas.MAX_AMOUNT for r in rows]
    assert [r["outcome"] == contracts.ACCEPTED for r in rows] == fits


WHOLES = {"3": 3, " 3 ": 3, "+3": 3, "3.0": 3, "03": 3, "3.00": 3, "1e0": None, "3.": None, "3.5": None, "": None}


def test_lenient_whole_numbers(spark):
    values = [*WHOLES, 3, 3.0, True, 3.5]
    rows = judge(spark, *[event("claim", f"event-{i:04}", severity=v) for i, v in enumerate(values)])
    assert [r["severity"] for r in rows] == [*WHOLES.values(), 3, 3, 1, None]


DAYS = {
    "2025-01-03": "2025-01-03", "2025-01-03T00:00:00": "2025-01-03", "2025-01-03T00:00:00Z": "2025-01-03",
    "2025-01-03 00:00": "2025-01-03", "2025-01-03T00:00:00+05:00": "2025-01-03", "1735862400": "2025-01-03",
    "0": "1970-01-01", "-86400": "1969-12-31", "20250103": None, "0000-01-01": None, " 2025-01-03": None,
    "2025-01-03Z": None, "1735862401": None,
}


def test_lenient_days(spark):
    values = [*DAYS, 1735862400, 1735862400000, 1735862400.0, 20250103, True]
    rows = judge(spark, *[event("payment", f"event-{i:04}", payment_date=v) for i, v in enumerate(values)])
    assert [r["payment_date"] for r in rows] == [*DAYS.values(), *["2025-01-03"] * 3, None, None]


INSTANTS = {
    "2025-01-03": "2025-01-03T00:00:00",
    "2025-01-03T01:02": "2025-01-03T01:02:00",
    "2025-01-03 01:02:03": "2025-01-03T01:02:03",
    "2025-01-03t01:02:03z": "2025-01-03T01:02:03+00:00",
    "2025-01-03_01:02:03Z": "2025-01-03T01:02:03+00:00",
    "2025-01-03T01:02:03.1234567Z": "2025-01-03T01:02:03.123456+00:00",
    "2025-01-03T01:02:03,123Z": "2025-01-03T01:02:03.123000+00:00",
    "2025-01-03T01:02:03.000Z": "2025-01-03T01:02:03+00:00",
    "2025-01-03T01:02:03+05:30": "2025-01-03T01:02:03+05:30",
    "2025-01-03T01:02:03-0530": "2025-01-03T01:02:03-05:30",
    "2025-01-03T01:02:03+23:59": "2025-01-03T01:02:03+23:59",
    "2025-01-03T01:02:03−05:30": "2025-01-03T01:02:03-05:30",
    "1735862400": "2025-01-03T00:00:00+00:00",
    "1735862400.5": "2025-01-03T00:00:00.500000+00:00",
    "2025-01-03T01:02:03+05": None,
    "2025-01-03T01:02:03 Z": None,
    "2025-01-03T01:02:60Z": None,
    "2025-01-03T1:02Z": None,
    "2025-01-03T01:02:03+24:00": None,
    "2025-01-03T01:02:03.Z": None,
    "1e9": None,
}


def test_lenient_instants(spark):
    values = [*INSTANTS, 1735862400, 1735862400000, True]
    rows = judge(spark, *[event("claim", f"event-{i:04}", reported_at=v) for i, v in enumerate(values)])
    assert [r["reported_at"] for r in rows] == [*INSTANTS.values(), *["2025-01-03T00:00:00+00:00"] * 2, None]


def test_occurred_at_is_utc(spark):
    times = ["2025-01-01T23:30:00-02:00", "2025-01-01T01:00:00+23:30", 1735862400]
    df = contracts.check(
        lines(spark, *[event("payment", f"event-{i:04}", envelope={"occurred_at": t}) for i, t in enumerate(times)])
    )
    found = df.orderBy("source_pos").selectExpr("cast(occurred_at as string)").collect()
    assert [r[0] for r in found] == ["2025-01-02 01:30:00", "2024-12-31 01:30:00", "2025-01-03 00:00:00"]


def test_strict_mode_has_no_defaults_and_no_lenient_envelope(spark):
    absent = with_key(drop="producer")
    cases = [absent, with_key(producer=""), with_key(event_version="1"), with_key(occurred_at=1735862400)]
    cases += [with_key(occurred_at="2025-03-01 10:00:00Z"), with_key()]
    strict = judge(spark, *cases, mode=contracts.STRICT)
    assert [r["outcome"] for r in strict] == [contracts.REJECTED] * 5 + [contracts.ACCEPTED]
    assert [r["outcome"] for r in judge(spark, *cases)] == [contracts.ACCEPTED] * 6
    with pytest.raises(ValueError, match="mode"):
        contracts.check(lines(spark, "{}"), mode="loose")


def test_known_event_with_broken_payload_is_a_duplicate(spark):
    checked = contracts.check(lines(spark, event("payment", amount=-1), with_key(event_id="short")))
    rows = contracts.classify(checked, F.lit(True)).orderBy("source_pos").collect()
    assert [r["outcome"] for r in rows] == [contracts.DUPLICATE, contracts.REJECTED]


def test_payload_columns_survive_classification(spark):
    tagged = contracts.classify(contracts.check(lines(spark, event("claim"), event("policy"))), F.lit(False))
    rows = tagged.orderBy("source_pos").collect()
    assert [r["status"] for r in rows] == ["open", "active"]
    assert len(tagged.columns) == len(set(tagged.columns))


def test_payload_of_another_entity_is_named_however_it_is_spelled(spark):
    usual = {**event("policy"), "event_type": "payment.issued"}
    text = {**event("policy", annual_premium="12"), "event_type": "payment.issued"}
    first, second = judge(spark, usual, text)
    assert first["reason"] == second["reason"]
    assert "payment_id: missing" in first["reason"] and "premium: unknown field" in first["reason"]


@pytest.mark.parametrize("amount", [1e30, 9.1e15, "inf"])
def test_amounts_beyond_the_models_decimals_are_rejected(spark, amount):
    [row] = judge(spark, event("claim", reserve_amount=amount))
    assert row["outcome"] == contracts.REJECTED and "reserve_amount" in row["reason"]
