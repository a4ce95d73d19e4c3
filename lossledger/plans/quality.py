"""Data tests over the built tables, service-level checks and the quality report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger import schemas
from lossledger.functions.numbers import round_half_up, share
from lossledger.operators import checks

MAX_REJECTION_RATE = 0.02

NEGATIVE_MONEY = "reserve_amount < 0 or paid_amount < 0 or outstanding_reserve < 0 or total_incurred < 0"
RISK_OUT_OF_RANGE = "risk_score < 0 or risk_score > 100"


class QualityGateError(RuntimeError):
    """A data test or service-level check failed."""


@dataclass(frozen=True)
class RowTest:
    """A test that looks at one row at a time: `failing` is true for rows that break it."""

    table: str
    name: str
    failing: str


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


ROW_TESTS = (
    RowTest("dim_policy_history", "not_null_policy_version_key", "policy_version_key is null"),
    RowTest("dim_policy_history", "not_null_policy_id", "policy_id is null"),
    RowTest("dim_policy_history", "accepted_values_status", f"status not in ({_listed(schemas.POLICY_STATUSES)})"),
    RowTest("dim_policy_current", "not_null_policy_id", "policy_id is null"),
    RowTest("fct_claims_current", "not_null_claim_id", "claim_id is null"),
    RowTest("fct_claims_current", "not_null_policy_id", "policy_id is null"),
    RowTest("fct_claims_current", "accepted_values_status", f"status not in ({_listed(schemas.CLAIM_STATUSES)})"),
    RowTest("fct_claims_current", "not_null_risk_score", "risk_score is null"),
    RowTest("fct_claims_current", "non_negative_financials", NEGATIVE_MONEY),
    RowTest("fct_claims_current", "risk_score_range", RISK_OUT_OF_RANGE),
    RowTest("claims_kpis", "not_null_total_claims", "total_claims is null"),
)

UNIQUE_KEYS = (
    ("dim_policy_history", "policy_version_key"),
    ("dim_policy_current", "policy_id"),
    ("fct_claims_current", "claim_id"),
)


def _row_test_results(df: DataFrame, table: str) -> DataFrame:
    """Failing rows of all row tests of a table, counted in one pass."""
    tests = [t for t in ROW_TESTS if t.table == table]
    counted = df.agg(*[F.count_if(F.expr(t.failing)).alias(t.name) for t in tests])
    pairs = F.array(*[F.struct(F.lit(t.name).alias("test"), F.col(t.name).alias("failures")) for t in tests])
    return counted.select(F.lit(table).alias("table"), F.inline(pairs))


def _count(failing: DataFrame, table: str, test: str) -> DataFrame:
    return failing.agg(F.count("*").alias("failures")).select(
        F.lit(table).alias("table"), F.lit(test).alias("test"), "failures"
    )


def data_tests(tables: dict[str, DataFrame]) -> DataFrame:
    """(`table`, `test`, `failures`) of the fifteen data tests."""
    results = [_row_test_results(tables[t], t) for t in dict.fromkeys(r.table for r in ROW_TESTS)]
    for table, key in UNIQUE_KEYS:
        results.append(_count(checks.unique(tables[table], key), table, f"unique_{key}"))
    orphans = checks.relationships(tables["fct_claims_current"], "policy_id", tables["dim_policy_current"])
    results.append(_count(orphans, "fct_claims_current", "relationships_policy_id"))
    first, *rest = results
    for other in rest:
        first = first.unionByName(other)
    return first


def claim_metrics(fact: DataFrame) -> DataFrame:
    """The figures the service-level checks look at, in one pass over the fact."""
    return fact.agg(
        F.count("*").alias("total_claims"),
        F.count_if(F.col("line_of_business").isNull()).alias("orphan_claims"),
        (F.count("*") - F.count_distinct("claim_id")).alias("duplicate_claims"),
        F.max("occurred_at").alias("max_event_time"),
    )


def slo_report(
    fact: DataFrame,
    source_events: Column,
    rejected_events: Column,
    max_rejection_rate: float = MAX_REJECTION_RATE,
) -> DataFrame:
    """One nested row: status, checks and metrics.

    The rejection check uses the exact rate; the reported rate is rounded.
    """
    rate = share(rejected_events, source_events)
    rows = claim_metrics(fact).select(
        F.struct(
            (F.col("total_claims") > 0).alias("claims_present"),
            (F.col("orphan_claims") == 0).alias("referential_integrity"),
            (F.col("duplicate_claims") == 0).alias("claim_uniqueness"),
            (rate <= max_rejection_rate).alias("rejection_rate_within_slo"),
        ).alias("checks"),
        F.struct(
            source_events.cast("bigint").alias("source_events"),
            rejected_events.cast("bigint").alias("rejected_events"),
            round_half_up(rate, 4).alias("rejection_rate"),
            F.col("total_claims"),
            F.col("max_event_time").cast("string").alias("max_event_time"),
        ).alias("metrics"),
    )
    passed = (
        F.col("checks.claims_present")
        & F.col("checks.referential_integrity")
        & F.col("checks.claim_uniqueness")
        & F.col("checks.rejection_rate_within_slo")
    )
    return rows.select(
        F.when(passed, "pass").otherwise("fail").alias("status"),
        F.current_timestamp().alias("checked_at"),
        "checks",
        "metrics",
    )
