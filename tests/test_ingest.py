from __future__ import annotations

import glob
import json
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

import pyarrow.parquet as pq
import pytest
from conftest import event, lines
from pyspark.sql import functions as F

from lossledger import commits
from lossledger.commits import CommitLog, create_exclusively, read_text
from lossledger.operators import ledger
from lossledger.plans import ingest, monitoring
from lossledger.sinks.bronze import read_dead_letters, remove_unused
from lossledger.sources import bronze, records
from lossledger.streaming.ingest import lines_stream, start_ingest


def run(spark, lake, tokens, batch_id, *rows):
    return ingest.ingest_batch(spark, lines(spark, *rows), lake, batch_id, tokens)


def test_second_run_finds_only_duplicates_and_no_clear_personal_data(spark, lake, tokens):
    first = run(spark, lake, tokens, "b1", event("policy"))
    second = run(spark, lake, tokens, "b2", event("policy"))
    assert (first.accepted, first.rejected, first.duplicates, first.files_written) == (1, 0, 0, 1)
    assert (second.accepted, second.rejected, second.duplicates, second.files_written) == (0, 0, 1, 0)
    [path] = glob.glob(f"{lake.bronze}/attempt=*/entity=policy/**/*.parquet", recursive=True)
    assert "/event_date=2025-03-01/batch_id=b1/" in path
    names = pq.ParquetFile(path).schema_arrow.names
    assert "customer_name" not in names and "customer_email" not in names
    assert "customer_name_token" in names and "customer_email_token" in names
    stored = bronze.read_entity(spark, lake.bronze, "policy").first()
    assert stored["customer_name_token"].startswith("tok_") and len(stored["customer_name_token"]) == 28


def test_quarantine_names_the_field_and_keeps_the_text(spark, lake, tokens):
    bad = json.dumps(event("policy", drop="policy_id"))
    result = run(spark, lake, tokens, "b1", bad, b"\xff\xfe")
    assert (result.accepted, result.rejected) == (0, 2)
    stored = {r["error_class"]: r for r in read_dead_letters(spark, lake.dead_letters).collect()}
    assert "policy_id" in stored["ValidationError"]["reason"]
    assert stored["ValidationError"]["raw"] == bad
    assert stored["UnicodeDecodeError"]["raw_base64"] == "//4="


def test_replaying_a_batch_id_changes_nothing(spark, lake, tokens):
    rows = [event("policy"), event("claim", "event-0002"), event("claim", "event-0002"), "{"]
    first = run(spark, lake, tokens, "b1", *rows)
    again = run(spark, lake, tokens, "b1", *rows)
    assert (first.accepted, first.rejected, first.duplicates) == (3, 1, 0)
    assert (again.accepted, again.rejected, again.duplicates) == (3, 1, 0)
    assert bronze.envelopes(spark, lake.bronze).count() == 3
    assert read_dead_letters(spark, lake.dead_letters).count() == 1
    counts = spark.read.parquet(lake.batch_counts)
    total = monitoring.totals(counts).first()
    assert (total["accepted"], total["rejected"], total["duplicates"]) == (3, 1, 0)


def test_known_id_with_broken_payload_and_conservation(spark, lake, tokens):
    run(spark, lake, tokens, "b1", event("payment"))
    rows = [event("payment", amount=-1), event("payment", "event-0002"), event("payment", "short"), ""]
    result = run(spark, lake, tokens, "b2", *rows)
    assert (result.accepted, result.rejected, result.duplicates) == (1, 2, 1)
    assert result.source_rows == len(rows)
    [metric] = monitoring.throughput(spark.read.parquet(lake.batch_metrics).where("batch_id = 'b2'")).collect()
    assert metric["source_rows"] == 4 and metric["accepted_share"] == 0.25


def test_ledger_check_without_broadcast_gives_the_same(spark, lake, tokens, monkeypatch):
    from lossledger.operators import dedup

    monkeypatch.setattr(dedup, "BROADCAST_BYTES", 0)
    run(spark, lake, tokens, "b1", event("payment"))
    result = run(spark, lake, tokens, "b2", event("payment"), event("payment"), event("payment", "event-0002"))
    assert (result.accepted, result.rejected, result.duplicates) == (1, 0, 2)


def test_last_event_is_the_last_to_arrive(spark, lake, tokens):
    late = {"occurred_at": "2024-01-01T00:00:00Z"}
    run(spark, lake, tokens, "b1", event("policy"), event("claim", "event-0002", envelope=late))
    stored = bronze.read_entity(spark, lake.bronze, "policy").select("occurred_at", "ingested_at", "source_pos")
    stored = stored.unionByName(
        bronze.read_entity(spark, lake.bronze, "claim").select("occurred_at", "ingested_at", "source_pos")
    )
    assert monitoring.last_event(stored).selectExpr("cast(last_event_at as string)").first()[0] == "2024-01-01 00:00:00"


def test_lines_keep_blank_rows_and_order(spark, tmp_path):
    path = tmp_path / "in.ndjson"
    path.write_text("a\n\nb\nc\n")
    rows = records.read_lines(spark, str(path)).orderBy("source_pos").collect()
    assert [r["value"] for r in rows] == ["a", "", "b", "c"]
    assert records.line_count(spark, str(path)) == 4
    assert records.line_count(spark, str(tmp_path / "absent")) == 0


def test_backfill_range_is_half_open_and_leaves_unreadable_lines(spark, lake, tokens, tmp_path):
    times = ["2025-01-01T00:00:00Z", "2024-12-31T23:59:59Z", "2025-01-02T00:00:00Z", "2025-01-01T23:30:00-02:00"]
    rows = [event("payment", f"event-{i:04}", envelope={"occurred_at": t}) for i, t in enumerate(times)]
    rows.append(event("payment", "event-naive", envelope={"occurred_at": "2025-01-01T00:00:00"}))
    path = tmp_path / "archive.ndjson"
    path.write_text("\n".join([json.dumps(r) for r in rows] + ["{broken"]))
    start, end = datetime(2025, 1, 1, tzinfo=UTC), datetime(2025, 1, 2, tzinfo=UTC)
    first = ingest.backfill(spark, str(path), start, end, lake, tokens)
    again = ingest.backfill(spark, str(path), start, end, lake, tokens)
    assert (first.accepted, first.rejected, first.duplicates) == (1, 0, 0)
    assert (again.accepted, again.rejected, again.duplicates) == (0, 0, 1)
    assert records.unreadable(records.read_lines(spark, str(path))).count() == 2
    with pytest.raises(ValueError, match="earlier"):
        ingest.backfill(spark, str(path), end, start, lake, tokens)


def test_structured_and_binary_records(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff"), {"a": "b"})], "n int, b binary, m map<string,string>")
    assert records.from_column(df, "m").first()["value"] == '{"a":"b"}'
    assert not records.from_column(df, "b").select(F.is_valid_utf8("value")).first()[0]
    with pytest.raises(TypeError):
        records.from_column(df, "n")


def test_stream_equals_batch_and_skips_ids_of_earlier_micro_batches(spark, tmp_path, tokens):
    from lossledger.lake import Lake

    source = tmp_path / "in"
    source.mkdir()
    first = [event("policy"), event("claim", "event-0002"), "oops"]
    second = [event("claim", "event-0002"), event("payment", "event-0003"), event("payment", "event-0003")]
    streamed, batched = Lake(str(tmp_path / "s")), Lake(str(tmp_path / "b"))
    checkpoint = str(tmp_path / "checkpoint")
    for i, part in enumerate((first, second)):
        text = "\n".join(r if isinstance(r, str) else json.dumps(r) for r in part)
        (source / f"{i}.ndjson").write_text(text + "\n")
        query = start_ingest(
            lines_stream(spark, str(source), 1), streamed, b"a key of the tests", checkpoint, name="t", available_now=True
        )
        query.awaitTermination()
        run(spark, batched, tokens, f"b{i}", *part)

    def ids(lake):
        return sorted(r[0] for r in bronze.envelopes(spark, lake.bronze).select("event_id").collect())

    assert ids(streamed) == ids(batched) == ["event-0001", "event-0002", "event-0003", "event-0003"]
    metrics = {r["batch_id"][-1]: r for r in spark.read.parquet(streamed.batch_metrics).collect()}
    assert (metrics["0"]["accepted"], metrics["0"]["rejected"]) == (2, 1)
    assert (metrics["1"]["accepted"], metrics["1"]["duplicates"]) == (2, 1)


def test_a_new_checkpoint_keeps_what_the_old_one_stored(spark, lake, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in (1, 2):
        (source / f"{i}.ndjson").write_text(json.dumps(event("policy", f"event-000{i}")) + "\n")
        if i == 2:
            (source / "1.ndjson").unlink()
        stream = lines_stream(spark, str(source), 1)
        start_ingest(stream, lake, b"a key of the tests", str(tmp_path / f"c{i}"), name="t", available_now=True).awaitTermination()
    assert sorted(r[0] for r in bronze.envelopes(spark, lake.bronze).select("event_id").collect()) == ["event-0001", "event-0002"]


def test_a_used_batch_id_refuses_another_input_unless_told(spark, lake, tokens):
    day = {"occurred_at": "2025-04-02T00:00:00Z"}
    run(spark, lake, tokens, "b1", event("policy"), event("claim", "event-0002", envelope=day), "{")
    with pytest.raises(ingest.BatchConflictError):
        run(spark, lake, tokens, "b1", event("policy", "event-0003"))
    assert bronze.envelopes(spark, lake.bronze).count() == 2
    rows = lines(spark, event("policy", "event-0003", envelope=day))
    result = ingest.ingest_batch(spark, rows, lake, "b1", tokens, replace=True)
    assert (result.accepted, result.files_written) == (1, 1)
    assert [r[0] for r in bronze.envelopes(spark, lake.bronze).select("event_id").collect()] == ["event-0003"]
    assert read_dead_letters(spark, lake.dead_letters).count() == 0


# --- Commits and the ledger index -------------------------------------------------------------


def rows_scanned(df):
    """Rows that the scans of a collected frame gave, before any filter but that of pages."""
    df.collect()
    leaves, total = df._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        total += leaves.apply(i).metrics().apply("numOutputRows").value()
    return total


def test_ledger_lookup_reads_what_the_batch_needs(spark, lake):
    log = CommitLog(spark, lake.bronze)
    ids = spark.range(0, 300_000, 1, 4).select(F.format_string("id-%09d", "id").alias("event_id"))
    assert ledger.acknowledge(ids, log, lake.ledger, "big") == (300_000, 0)
    few = spark.createDataFrame([(f"id-{i:09}",) for i in (5, 77_777, 299_999, 300_000, 400_000)], "event_id string")
    found = ledger.lookup(few, lake.ledger, log.latest(), True)
    assert sorted(r[0] for r in found.collect()) == ["id-000000005", "id-000077777", "id-000299999"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hashes = [r[0] for r in few.select(F.xxhash64("event_id")).collect()]
        narrow = rows_scanned(ledger.scan(spark, lake.ledger, log.latest()).where(F.col("h").isin(*hashes)))
        whole = rows_scanned(ledger.scan(spark, lake.ledger, log.latest()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert whole == 300_000 and narrow <= len(hashes) * ledger.PAGE_ROWS
    assert ledger.acknowledge(few, log, lake.ledger, "few") == (2, 3)


def test_runs_merge_geometrically_and_forget_replaced_attempts(spark, lake, monkeypatch):
    monkeypatch.setattr(ledger, "FAN", 3)
    log = CommitLog(spark, lake.bronze)
    for batch in range(10):
        ids = spark.createDataFrame([(f"id-{i}",) for i in range(batch * 4, batch * 4 + 6)], "event_id string")
        new, known = ledger.acknowledge(ids, log, lake.ledger, f"b{batch}")
        assert (new, known) == ((6, 0) if not batch else (4, 2))
    last = log.latest()
    assert sorted(r["level"] for r in last.runs) == [0, 2] and sum(r["rows"] for r in last.runs) == 42
    assert log.last_version() == 10 + 3 + 1
    assert log.commit(last, runs=list(last.runs), dead=[log.read(1).body["attempt"]], batch_id=None)
    assert ledger.scan(spark, lake.ledger, log.latest()).count() == 36


def test_two_writers_lose_nothing(spark, lake, tokens, monkeypatch):
    """A second writer commits while the first one writes: the first sees its ids and tries again."""
    attempts = []
    write = ingest.write_bronze

    def meanwhile(rows, root, entity, attempt):
        write(rows, root, entity, attempt)
        if not attempts:
            attempts.append(attempt)
            run(spark, lake, tokens, "other", event("claim", "event-0002"), event("payment", "event-0004"))

    monkeypatch.setattr(ingest, "write_bronze", meanwhile)
    result = run(spark, lake, tokens, "mine", event("policy"), event("claim", "event-0002"))
    assert (result.accepted, result.duplicates) == (1, 1)
    stored = {(r.event_id, r.batch_id) for r in bronze.envelopes(spark, lake.bronze).collect()}
    assert stored == {("event-0001", "mine"), ("event-0002", "other"), ("event-0004", "other")}
    assert remove_unused(spark, lake.bronze, lake.ledger) == []
    gone = remove_unused(spark, lake.bronze, lake.ledger, hours=-1)
    assert f"attempt={attempts[0]}" in gone and bronze.envelopes(spark, lake.bronze).count() == 3


def test_only_one_of_two_gets_a_version(spark, lake):
    with ThreadPoolExecutor(8) as pool:
        path = f"{lake.bronze}/_commits/{1:020d}.json"
        won = list(pool.map(lambda i: create_exclusively(spark, path, f'{{"writer": {i}}}'), range(8)))
    assert sum(won) == 1 and json.loads(read_text(spark, path)) == {"writer": won.index(True)}


def test_checkpoints_hold_the_live_batches(spark, lake, monkeypatch):
    monkeypatch.setattr(commits, "CHECKPOINT_EVERY", 3)
    log = CommitLog(spark, lake.bronze)
    assert log.folders() == [] and log.last_version() == 0
    for i, batch in enumerate(["a", "b", "a", "c", "b", "d", "d"]):
        folders = [{"entity": "claim", "days": ["2025-01-01"]}]
        assert log.commit(log.latest(), runs=[], dead=[], batch_id=batch, attempt=f"a{i}", folders=folders)
    assert log.attempts() == {"a2", "a3", "a4", "a6"} and log.attempts(2) == {"a0", "a1"}
    assert log.folders("claim") and log.folders("policy") == []
    assert not log.commit(log.read(3), runs=[], dead=[], batch_id="e", attempt="late", folders=[])
