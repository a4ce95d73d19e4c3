from __future__ import annotations

import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lossledger.functions.tokens import Tokenizer  # noqa: E402
from lossledger.lake import Lake  # noqa: E402
from lossledger.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tokens(spark):
    return Tokenizer.create(spark, b"own-key")


@pytest.fixture
def lake(tmp_path):
    return Lake(str(tmp_path / "lake"))


PAYLOADS = {
    "policy": {
        "policy_id": "p-1",
        "customer_id": "c-1",
        "customer_name": "Robin Example",
        "customer_email": "Robin@Mail.Example",
        "line_of_business": "property",
        "state": "NY",
        "effective_date": "2025-01-01",
        "expiration_date": "2026-01-01",
        "annual_premium": 1200.5,
        "coverage_limit": 100000,
        "deductible": 0,
        "status": "active",
    },
    "claim": {
        "claim_id": "k-1",
        "policy_id": "p-1",
        "claimant_name": "Robin Example",
        "claimant_email": "robin@mail.example",
        "loss_date": "2025-02-01",
        "reported_at": "2025-02-03T00:00:00Z",
        "claim_type": "theft",
        "state": "NY",
        "reserve_amount": 5000.25,
        "paid_amount": 0,
        "status": "open",
        "adjuster_id": "desk-7",
        "severity": 3,
        "source_system": "letter",
    },
    "payment": {
        "payment_id": "y-1",
        "claim_id": "k-1",
        "payment_date": "2025-03-01",
        "amount": 10.5,
        "payment_type": "repair",
        "payee_name": "Corner Garage",
        "payment_status": "issued",
    },
}


def event(entity: str, event_id: str = "event-0001", drop: str | None = None, envelope=None, **payload) -> dict:
    """A valid event of an entity with changes to its payload or envelope."""
    body = {**PAYLOADS[entity], **payload}
    if drop:
        del body[drop]
    return {
        "event_id": event_id,
        "event_type": f"{entity}.created",
        "event_version": 1,
        "occurred_at": "2025-03-01T10:00:00Z",
        "producer": "unit",
        "correlation_id": "corr-0001",
        "payload": body,
        **(envelope or {}),
    }


def lines(spark, *records):
    """A record frame from dicts, text or bytes, in order."""
    rows = []
    for i, r in enumerate(records):
        raw = r if isinstance(r, bytes) else (r if isinstance(r, str) else json.dumps(r)).encode()
        rows.append((bytearray(raw), ("test", 0, i)))
    df = spark.createDataFrame(rows, "value binary, source_pos struct<source:string,block:bigint,row:bigint>")
    return df.selectExpr("cast(value as string) as value", "source_pos")
