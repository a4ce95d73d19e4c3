"""Incremental tables against full builds, and the archive's zone map."""

from __future__ import annotations

import bisect
import json
import random
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal

import pytest
from conftest import event
from pyspark.sql import functions as F

from lossledger import schemas
from lossledger.operators import checks, rates
from lossledger.operators.keyed_state import StateStore
from lossledger.plans import gold, incremental, monitoring, silver
from lossledger.sources import archive, records
from lossledger.streaming.rates import restating_rate

START = datetime(2025, 1, 1, tzinfo=UTC)


def staged(spark, entity, rows):
    """Staged rows from partial dicts."""
    build = {"policy": silver.stg_policies, "claim": silver.stg_claims, "payment": silver.stg_payments}[entity]
    schema = build(spark.createDataFrame([], schemas.bronze_schema(entity))).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def policy(i, name, minutes, **more):
    at = START + timedelta(minutes=minutes)
    base = {"event_id": f"e{i:05}", "policy_id": name, "occurred_at": at, "ingested_at": at, "state": "XY", "status": "active"}
    return base | {"line_of_business": "boat", "coverage_limit": Decimal("1000.00")} | more


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, str(tmp_path / "state"))


def test_history_in_any_order_equals_the_full_build(spark, store):
    rnd = random.Random(3)
    rows = [policy(i, f"p{rnd.randrange(6)}", rnd.randrange(40)) for i in range(60)] + [policy(99, None, 5)]
    rnd.shuffle(rows)
    whole = staged(spark, "policy", rows)
    for k in range(4):
        limits = {"share": 1e-9, "min_rows": 3} if k % 2 else {}  # the way of heavy policies too
        incremental.update_history(store, staged(spark, "policy", rows[k::4]), f"b{k}", buckets=4, **limits)
    assert incremental.update_history(store, staged(spark, "policy", rows[0::4]), "b0", buckets=4) == []
    assert rows_of(incremental.policy_history(store, whole, 4)) == rows_of(silver.dim_policy_history(whole))


def test_a_late_event_splits_one_interval_and_leaves_other_buckets_alone(spark, store):
    rows = [policy(i, f"p{i % 20}", i) for i in range(40)]
    first = staged(spark, "policy", rows)
    incremental.update_history(store, first, "b0", buckets=8)
    before = store.log.latest()
    late = staged(spark, "policy", [policy(900, "p7", 10)])
    touched = incremental.update_history(store, late, "b1", buckets=8)
    assert len(touched) == 1
    after = store.log.latest()
    moved = {r["bucket"] for r in after.runs} - {r["bucket"] for r in before.runs if r in after.runs}
    assert moved == set(touched)
    table = incremental.history_table(first, 8)
    opened = store.read(table, after, touched).select(F.col("_metadata.file_path")).distinct().collect()
    assert opened and all(f"/bucket={touched[0]}/" in r[0] for r in opened)
    ends = {r.valid_from: r.valid_to for r in incremental.policy_history(store, first, 8).where("policy_id = 'p7'").collect()}
    times = sorted(ends)
    assert len(times) == 3 and [ends[t] for t in times] == [*times[1:], None]


def test_an_update_without_its_marker_is_not_applied_twice(spark, store, monkeypatch):
    rows = staged(spark, "policy", [policy(1, "p1", 1)])
    incremental.update_history(store, rows, "b0", buckets=2)  # its marker would come with the next update
    assert incremental.update_history(store, rows, "b0", buckets=2) == []
    assert incremental.policy_history(store, rows, 2).count() == 1


def test_two_updates_at_once_keep_both(spark, store, monkeypatch):
    first, second = (staged(spark, "policy", [policy(i, "p1", i)]) for i in (1, 2))
    replace, seen = StateStore.replace, []

    def meanwhile(self, base, changes, **note):
        if not seen:
            seen.append(1)
            incremental.update_history(store, second, "other", buckets=2)
        return replace(self, base, changes, **note)

    monkeypatch.setattr(StateStore, "replace", meanwhile)
    incremental.update_history(store, first, "mine", buckets=2)
    assert [r.is_current for r in incremental.policy_history(store, first, 2).orderBy("valid_from").collect()] == [False, True]


def claim(i, name, minutes, **more):
    at = START + timedelta(minutes=minutes)
    base = {"event_id": f"c{i:05}", "claim_id": name, "policy_id": f"p{int(name[1:]) % 3}", "occurred_at": at, "ingested_at": at}
    base |= {"loss_date": date(2025, 1, 1 + i % 3), "reported_at": at + timedelta(days=i % 12), "state": "XY", "severity": i % 5 + 1}
    return base | {"reserve_amount": Decimal(100 * i), "reported_paid_amount": Decimal(7 * i), "status": ("open", "closed")[i % 2]} | more


def payment(i, name, amount):
    at = START + timedelta(minutes=i)
    return {"event_id": f"y{i:05}", "claim_id": name, "occurred_at": at, "amount": Decimal(amount), "payment_status": ("issued", "void")[i % 4 == 3]}


def test_metrics_after_corrections_equal_the_full_build(spark, store):
    rnd = random.Random(6)
    claims = [claim(i, f"k{rnd.randrange(12)}", rnd.randrange(200)) for i in range(50)]
    payments = [payment(i, f"k{rnd.randrange(14)}", rnd.randrange(1, 900)) for i in range(40)]  # some before or without a claim
    rnd.shuffle(claims)
    older, newer = ([policy(i, f"p{i}", 1, line_of_business=line) for i in range(n)] for line, n in (("boat", 2), ("home", 3)))
    for k in range(3):
        current = silver.latest_policy(staged(spark, "policy", newer if k == 2 else older))
        args = staged(spark, "claim", claims[k::3]), staged(spark, "payment", payments[k::3]), current
        incremental.update_claims(store, *args, f"b{k}", buckets=4)
    assert incremental.update_claims(store, *args, "b2", buckets=4) == []
    everything = staged(spark, "claim", claims)
    full = silver.fct_claims_current(everything, staged(spark, "payment", payments), current)
    assert rows_of(incremental.claims_fact(store, everything, 4)) == rows_of(full)
    assert rows_of(incremental.daily_metrics(store)) == rows_of(gold.daily_claim_metrics(full))
    sums = store.read(incremental.metrics_table())
    assert checks.outside(sums, "claim_count <= 0", "claim_count").count() == 0


# --- Archive ----------------------------------------------------------------------------------


def test_a_replay_opens_only_overlapping_files(spark, tmp_path):
    folder, index = tmp_path / "an archive", str(tmp_path / "zones")
    folder.mkdir()

    def write(name, *times):
        (folder / name).write_text("\n".join(json.dumps(event("payment", f"event-{t}", envelope={"occurred_at": t})) for t in times))

    for day in range(1, 6):
        write(f"{day}.json", f"2025-01-0{day}T01:00:00Z", f"2025-01-0{day}T23:00:00+01:00")
    (folder / "broken.json").write_text("{oops\n")
    assert len(archive.refresh(spark, str(folder), index)) == 6
    assert archive.refresh(spark, str(folder), index) == []
    span = datetime(2025, 1, 3, tzinfo=UTC), datetime(2025, 1, 4, tzinfo=UTC)

    def replay():
        found = archive.read_archive(spark, str(folder), index, *span)
        same = records.read_archive(spark, str(folder), *span)
        assert sorted(r.value for r in found.collect()) == sorted(r.value for r in same.collect())
        return [name.rsplit("/", 1)[1] for name in archive.files_between(spark, str(folder), index, *span)], found.count()

    assert replay() == (["3.json"], 2)
    write("4.json", "2025-01-03T05:00:00Z", "2025-01-03T06:00:00Z", "2025-01-09T00:00:00Z")  # changed since
    write("6.json", "2025-01-03T12:00:00Z")  # not known yet
    assert replay() == (["3.json", "4.json", "6.json"], 5)
    assert len(archive.refresh(spark, str(folder), index)) == 2
    write("6.json", "2025-02-03T12:00:00Z", "2025-02-04T12:00:00Z")
    assert replay()[1] == 4
    zone = archive.read_zones(spark, index).where("file like '%broken%'").first()
    assert (zone.lines, zone.unreadable, zone.first_at) == (1, 1, None)
    none = datetime(2030, 1, 1, tzinfo=UTC), datetime(2030, 1, 2, tzinfo=UTC)
    archive.refresh(spark, str(folder), index)
    assert archive.read_archive(spark, str(folder), index, *none).count() == 0


# --- Rates and counters -------------------------------------------------------------------------


def test_sketch_has_no_ceiling_and_a_bounded_rank_error(spark):
    rows = spark.range(60_000).select(
        F.timestamp_seconds(F.col("id") % 120 + 1_700_000_040).alias("at"), F.exp(F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("s")
    )
    found = rates.sliding_latency_sketch(rows, "at", "s").orderBy("range_end").collect()
    bucketed = rates.sliding_latency(rows, "at", "s").orderBy("range_end").collect()
    assert [r.batches for r in found] == [r.batches for r in bucketed] and len(found) == 6
    values = sorted(r.s for r in rows.collect())
    for r in found[1:5]:  # ranges that hold both minutes
        assert max(b.latency_seconds for b in bucketed) <= 10 < r.latency_seconds
        assert abs(bisect.bisect(values, r.latency_seconds) / len(values) - 0.95) < 0.02
    assert rates.sliding_latency_sketch(rows.limit(0), "at", "s").count() == 0


def test_restarted_stream_keeps_its_ranges(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    minutes = [0, 7, 2, 7, 1, 30, 0]
    for part, some in enumerate((minutes[:3], minutes[3:5], minutes[5:])):  # later files hold earlier times
        (source / f"{part}.json").write_text("\n".join(json.dumps({"at": f"2025-01-01T23:{m + 20}:30Z", "entity": "claim"}) for m in some))
        stream = spark.readStream.schema("at timestamp, entity string").json(str(source))
        restating_rate(stream, state, str(tmp_path / "c"), "at", "entity", name="r", available_now=True).awaitTermination()
    log = spark.read.schema("at timestamp, entity string").json(str(source))
    got = incremental.published_rates(StateStore(spark, state), "entity")
    assert rows_of(got) == rows_of(rates.sliding_rate(log, "at", ["entity"]))


def test_counters_add_up_once_a_batch(spark, store):
    counts = spark.createDataFrame([("accepted", "claim", None, 3), ("rejected", None, "x", 1)], "outcome string, entity string, error_class string, rows long")
    for batch in ("a", "b", "b"):
        incremental.update_counters(store, counts, batch)
    assert {(r.outcome, r.rows) for r in incremental.counters(store).collect()} == {("accepted", 6), ("rejected", 2)}
    assert monitoring.totals(incremental.counters(store)).first()["accepted"] == 6


def test_an_update_computes_its_batch_once(spark, store):
    claims = staged(spark, "claim", [claim(i, f"k{i % 4}", i) for i in range(9)])
    payments = staged(spark, "payment", [payment(i, f"k{i % 5}", 10) for i in range(7)])
    current = silver.latest_policy(staged(spark, "policy", [policy(i, f"p{i}", 1) for i in range(3)]))
    seen = spark.sparkContext.accumulator(0)

    def noted(df):
        return spark.createDataFrame(df.rdd.map(lambda r: (seen.add(1), r)[1]), df.schema)

    incremental.update_claims(store, noted(claims), noted(payments), noted(current), "b0", buckets=2)
    assert seen.value == 9 + 7 + 3
    fact = silver.fct_claims_current(claims, payments, current)
    assert rows_of(incremental.claims_fact(store, claims, 2)) == rows_of(fact)
