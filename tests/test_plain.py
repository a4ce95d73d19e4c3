"""Records of plain text are checked without being parsed as documents, with the same results."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

from conftest import event, lines
from pyspark.sql import functions as F

from lossledger.operators import contracts
from lossledger.plans import ingest
from lossledger.sources import records


def read(spark, *given):
    rows = contracts.read_plain(lines(spark, *given), contracts._struct_fields())
    return rows.withColumn("_whole", contracts._whole()).withColumn("_sound", contracts._sound(False))


def test_whole_plain_records_are_not_parsed_as_documents(spark):
    shuffled = dict(reversed(event("claim").items()))
    given = [*map(event, ("policy", "claim", "payment")), shuffled, event("claim", status="gone"), event("claim", drop="status")]
    rows = contracts._typed(read(spark, *given)).orderBy("source_pos.row")
    assert [r[0] for r in rows.select("_sound").collect()] == [True, True, True, True, False, False]
    assert [r[0] for r in rows.select(F.col("_document").isNotNull()).collect()] == [False] * 5 + [True]


def test_odd_texts_are_not_plain(spark):
    plain = json.dumps(event("claim"))
    assert read(spark, plain).first()["_sound"]
    odd = [
        plain + " {}",
        plain.replace('"', "'"),
        plain.replace('"k-1"', '"k\\u002d1"'),
        plain.replace('"k-1"', '["k-1"]'),
        plain.replace('"k-1"', "null"),
        plain.replace('"k-1"', '"k\x01"'),
        plain.replace('"severity": 3', '"severity": 3.0'),
        plain.replace('"severity": 3', '"severity": 12345678901234567890'),
        plain.replace("5000.25", "NaN"),
        plain.replace("5000.25", '"5000.25"'),
        plain.replace("5000.25", "05000"),
        plain.replace('"status"', '"payment_id"'),
        plain.replace("2025-02-01", "2025-02-30"),
        plain.replace("10:00:00Z", "10:00:00"),
        plain.replace("claim.created", "policy.created"),
        plain.encode().replace(b"k-1", b"k\xff1"),
    ]
    assert not any(r["_sound"] for r in read(spark, *odd).collect())


def test_one_event_in_two_spellings_has_the_same_values(spark):
    def spelled(e):
        return json.dumps(e).replace('"state"', '"st\\u0061te"')

    given = []
    for e in (event("policy"), event("claim"), event("payment"), event("claim", severity=9), event("policy", deductible=-1)):
        del e["producer"]
        given += [json.dumps(e), spelled(e)]
    for mode in (contracts.LAX, contracts.STRICT):
        tagged = contracts.classify(contracts.check(lines(spark, *given), mode=mode), F.lit(False)).orderBy("source_pos.row")
        rows = [r.asDict(recursive=True) for r in tagged.drop("value", "source_pos").collect()]
        assert rows[0::2] == [r | {"reason": p["reason"], "errors": p["errors"]} for r, p in zip(rows[1::2], rows[0::2], strict=True)]
        assert {r["outcome"] for r in rows[:4]} == {contracts.REJECTED if mode == contracts.STRICT else contracts.ACCEPTED}


def test_times_of_plain_texts_are_those_of_documents(spark):
    stamps = ("2025-03-01T10:00:00Z", "2025-03-01T10:00:00.120000+05:30", "2025-03-01T23:59:59-10:00")
    given = [json.dumps(event("claim", envelope={"occurred_at": at})) for at in stamps]
    given += [g.replace('"state"', '"st\\u0061te"') for g in given]
    times = [r["_time"] for r in records.timed(lines(spark, *given)).orderBy("source_pos.row").collect()]
    assert times[:3] == times[3:] and all(times)
    start, end = datetime(2025, 3, 1, tzinfo=UTC), datetime(2025, 3, 2, tzinfo=UTC)
    assert records.records_between(lines(spark, *given), start, end).count() == 4


def test_a_ledger_join_on_the_event_id_is_planned_without_tracing_it_back(spark):
    checked = contracts.check(lines(spark, event("claim")))
    known = spark.createDataFrame([("event-0001",)], "event_id string")
    tagged = ingest.tag(checked, known, fits=False)
    started = time.perf_counter()
    tagged._jdf.queryExecution().optimizedPlan()
    assert time.perf_counter() - started < 8
    assert tagged.first()["outcome"] == contracts.DUPLICATE
