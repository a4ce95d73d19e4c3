"""Plans that keep the work of large inputs small."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pytest
from conftest import event, lines
from pyspark.sql import functions as F

from lossledger.fixtures import queries
from lossledger.operators import contracts, dedup, ledger
from lossledger.operators.settle import settled
from lossledger.operators.stored_events import StoredEvents
from lossledger.plans import ingest, silver
from lossledger.session import path_exists
from lossledger.sources import records


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_boundary_leaves_out_unread_columns_and_keeps_filters_above(spark):
    wide = spark.range(5).select("id", F.sha2(F.col("id").cast("string"), 256).alias("unread"), (F.col("id") * 2).alias("read"))
    step = settled(wide)
    assert step.columns == wide.columns
    assert sorted(step.collect()) == sorted(wide.collect())
    found = plan(step.where("read > 4").select("read"))
    assert "sha2" not in found
    assert found.index("Filter") < found.index("Generate")


def test_counting_outcomes_builds_no_stored_values(spark):
    counts = contracts.classify(contracts.check(lines(spark, event("claim"))), F.lit(False)).groupBy("outcome").count()
    found = plan(counts)
    assert "lower(" not in found and "unknown_producer" not in found
    assert counts.collect() == [("accepted", 1)]


def test_a_range_reads_each_time_once(spark):
    start, end = datetime(2025, 1, 1, tzinfo=UTC), datetime(2026, 1, 1, tzinfo=UTC)
    found = records.records_between(lines(spark, event("claim"), "no json"), start, end)
    assert plan(found).index("Filter") < plan(found).index("Generate")  # not merged into the steps that read the time
    assert found.count() == 1


def test_rows_without_an_id_are_flagged_in_the_one_pass_over_the_batch(spark):
    rows = [("a", 1), ("b", 2), (None, 3), (None, 3), ("a", 4)]
    batch = spark.createDataFrame(rows, "event_id string, n int")
    seen = spark.sparkContext.accumulator(0)
    noted = spark.createDataFrame(batch.rdd.map(lambda r: (seen.add(1), r)[1]), batch.schema)
    known = spark.createDataFrame([("a",)], "event_id string")
    flagged = dedup.flag_known(noted, known, fits=False)
    assert flagged.columns == ["event_id", "n", "is_known"]
    found = sorted((r["n"], r["is_known"]) for r in flagged.collect())
    assert found == [(1, True), (2, False), (3, False), (3, False), (4, True)]
    assert seen.value == len(rows)


def test_repeated_keys_and_signed_zeros_are_read_as_the_document_has_them(spark):
    doubled = json.dumps(event("claim")).replace('"event_version": 1', '"event_version": "x", "event_version": 7')
    doubled = doubled.replace('"severity": 3', '"severity": [1], "severity": 4')
    zero = json.dumps(event("claim", paid_amount=0)).replace('"paid_amount": 0', '"paid_amount": -0.0')
    twice = json.dumps(event("claim")) + " {}"
    tagged = contracts.classify(contracts.check(lines(spark, doubled, zero, twice)), F.lit(False)).orderBy("source_pos")
    first, second, third = tagged.collect()
    assert (first["outcome"], first["event_version"], first["severity"]) == ("accepted", 7, 4)
    assert str(second["paid_amount"]) == "0.0"
    assert third["error_class"] == contracts.JSON_ERROR


def test_stored_lines_are_compressed(spark, monkeypatch):
    given = lines(spark, *(event("claim", event_id=f"event-{i:06}") for i in range(500)))
    monkeypatch.setattr(queries.fx, "all_raw_lines", lambda *_: given)
    path = queries._stored_lines(spark, "")
    assert path_exists(spark, f"{path}/*.gz")
    stored = records.read_lines(spark, path)
    assert sorted(r["value"] for r in stored.collect()) == sorted(r["value"] for r in given.collect())
    assert records.line_count(spark, path) == 500


def noted(df, seen):
    """The same rows, counted in `seen` whenever they are computed."""
    return df.sparkSession.createDataFrame(df.rdd.map(lambda r: (seen.add(1), r)[1]), df.schema)


@pytest.fixture
def tables(spark, tmp_path):
    """Tables of one row group each."""
    at = datetime(1996, 3, 1)
    stamp = "timestamp_ntz"
    frames = {
        "nation": ([(1, "N")], "n_nationkey long, n_name string"),
        "customer": (
            [(7, "Customer#7", 1, "HOUSEHOLD", 10.0)],
            "c_custkey long, c_name string, c_nationkey long, c_mktsegment string, c_acctbal double",
        ),
        "orders": (
            [(i, 7, "F", "1-URGENT", at, 20.0) for i in range(9)],
            f"o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate {stamp}, o_totalprice double",
        ),
        "lineitem": (
            [(i, 1, 5, 3, 4.0, 30.0, 0.1, 0.2, "N", "O", at) for i in range(9)],
            "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
            f"l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate {stamp}",
        ),
        "events": (
            [(i, at, 3, "click", 1.5) for i in range(9)],
            f"event_id long, ts {stamp}, user_id long, event_type string, value double",
        ),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_lines_of_one_row_group_are_made_by_several_tasks(spark, tables):
    made = {e: queries.fx.raw_lines(spark, tables, e) for e in queries.schemas.ENTITIES}
    made["feed"] = queries.fx.feed_records(spark, tables)
    for name, found in made.items():
        tasks = found.withColumn("task", F.spark_partition_id()).collect()
        assert len(tasks) == 9, name
        assert len({r["task"] for r in tasks}) > 1, name


def test_a_run_of_many_ids_is_sorted_by_several_tasks(spark, tmp_path):
    ids = spark.range(100).select(F.col("id").cast("string").alias("event_id"))
    run = ledger.write_run(ids, str(tmp_path), "b", "a", 8 << 20)
    assert run["rows"] == 100
    assert len(list((tmp_path / run["name"]).glob("*.parquet"))) > 1


def test_outcomes_check_each_line_once(spark, monkeypatch):
    given = lines(spark, event("claim", event_id="event-0001"), event("claim", event_id="event-0002"), "no json", "no json")
    seen = spark.sparkContext.accumulator(0)
    earlier = spark.createDataFrame([("event-0001",), ("event-0001",), ("event-0009",)], "event_id string")
    monkeypatch.setattr(queries.fx, "all_raw_lines", lambda *_: noted(given, seen))
    monkeypatch.setattr(queries, "_earlier_ids", lambda *_: earlier)
    found = queries._tagged(spark, "").groupBy("outcome").count().collect()
    assert sorted(map(tuple, found)) == [("accepted", 1), ("duplicate", 1), ("rejected", 2)]
    assert seen.value == 4


def test_a_shuffled_batch_meets_its_ledger_once(spark, lake, tokens, monkeypatch):
    given = lines(spark, event("claim", event_id="event-0001"), event("policy", event_id="event-0002"), "no json")
    more = lines(spark, event("claim", event_id="event-0001"), event("payment", event_id="event-0003"), "no json")
    seen, flag = spark.sparkContext.accumulator(0), dedup.flag_known
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ingest, "flag_known", lambda *a: noted(flag(*a), seen))
    first = ingest.ingest_batch(spark, given, lake, "b1", tokens)
    assert (first.accepted, first.rejected, first.duplicates) == (2, 1, 0)
    assert seen.value == 0  # an empty ledger knows nothing
    second = ingest.ingest_batch(spark, more, lake, "b2", tokens)
    assert (second.accepted, second.rejected, second.duplicates) == (1, 1, 1)
    assert seen.value == 3


def shuffled(df):
    """The columns of each shuffle of a plan."""
    found, left = [], [df._jdf.queryExecution().executedPlan().initialPlan()]
    while left:
        node = left.pop()
        left += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            found.append(node.output().mkString(","))
    return found


def test_whole_claims_are_not_shuffled(spark, tables, lake):
    for name in ("latest_claim", "fct_claims_current"):
        found = shuffled(queries.QUERIES[name](spark, tables))
        assert found and not any("claimant_name_token" in columns or "adjuster_id" in columns for columns in found), name


def test_stored_events_give_the_rows_of_the_plain_plans(spark, tables):
    def changed(df, **new):
        return df.withColumns({n: F.expr(v) for n, v in new.items()})

    bronze = queries.fx.bronze(spark, tables, "claim")
    later = "ingested_at + interval 1 day"
    claims = bronze
    for more in (
        changed(bronze, ingested_at=later, claim_id="'1'", state="'ZZ'"),  # a later copy under another claim
        changed(bronze, event_id="concat(event_id, 'x')", claim_id="cast(cast(claim_id as int) % 3 as string)"),
        changed(bronze, event_id="cast(null as string)", ingested_at=later, state="'NN'", claim_id="'n'").limit(1),
        changed(bronze, event_id="concat(event_id, 'y')", claim_id="cast(null as string)", state="'KK'"),
        changed(bronze, event_id="concat(event_id, 'z')", policy_id="cast(null as string)", occurred_at="cast(null as timestamp)"),
        bronze,  # equal copies
    ):
        claims = claims.unionByName(more)
    stored = StoredEvents.store(claims, silver.UNSTAGED)
    plain = silver.stg_claims(claims)
    payments = silver.stg_payments(queries.fx.bronze(spark, tables, "payment"))
    raw = queries.fx.bronze(spark, tables, "policy")
    policies = raw.unionByName(changed(raw, ingested_at=later, state="'QQ'")).unionByName(
        changed(raw, event_id="concat(event_id, 'p')", policy_id="cast(null as string)")
    )
    kept = StoredEvents.store(policies, silver.UNSTAGED)
    current = silver.latest_policy(silver.stg_policies(policies))

    def rows(df):
        return sorted(map(str, df.collect()))

    assert rows(silver.stored_latest_claim(stored)) == rows(silver.latest_claim(plain))
    fact = silver.fct_claims_current(plain, payments, current)
    found = silver.stored_claims_current(stored, payments, current)
    assert found.schema.names == fact.schema.names
    assert rows(found) == rows(fact) and len(rows(fact)) > 5
    history = silver.dim_policy_history(silver.stg_policies(policies))
    assert rows(silver.stored_policy_history(kept)) == rows(history)
    # The way of heavy policies too; it gives no rows to a policy without an id.
    limits = {"share": 1e-9, "min_rows": 3}
    assert rows(silver.stored_policy_history(kept, **limits)) == rows(silver.dim_policy_history(silver.stg_policies(policies), **limits))
