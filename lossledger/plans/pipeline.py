"""The ordered run: Bronze to a candidate Silver and Gold, tests, checks, then publication."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger import schemas
from lossledger.lake import Lake
from lossledger.operators.stored_events import StoredEvents
from lossledger.plans import gold, quality, silver
from lossledger.session import configure
from lossledger.sinks.tables import (
    publish_run,
    register_tables,
    register_views,
    write_report,
    write_table,
)
from lossledger.sources.bronze import read_entity
from lossledger.sources.records import line_count

TABLES = {
    "silver": ["dim_policy_history", "dim_policy_current", "fct_claims_current"],
    "gold": ["claims_kpis", "daily_claim_metrics", "high_risk_claims"],
}


@dataclass(frozen=True)
class RunReport:
    run_id: str
    published: bool
    failed_tests: list[tuple[str, str, int]]
    status: str


def build_run(lake: Lake, run_id: str, bronze: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Write every table of a run; each later table starts from the ones already written.

    `bronze` holds one frame per entity.
    """
    policies, claims = (StoredEvents.store(bronze[entity], silver.UNSTAGED) for entity in ("policy", "claim"))
    payments = silver.stg_payments(bronze["payment"])
    staged = {"stg_policies": silver.stg_policies(policies.rows), "stg_claims": silver.stg_claims(claims.rows)}
    register_views({**staged, "stg_payments": payments})

    tables: dict[str, DataFrame] = {}

    def keep(schema: str, name: str, df: DataFrame) -> DataFrame:
        tables[name] = write_table(df, lake, run_id, schema, name)
        return tables[name]

    history = keep("silver", "dim_policy_history", silver.stored_policy_history(policies))
    current = keep("silver", "dim_policy_current", silver.dim_policy_current(history))
    fact = keep("silver", "fct_claims_current", silver.stored_claims_current(claims, payments, current))
    keep("gold", "claims_kpis", gold.claims_kpis(fact))
    keep("gold", "daily_claim_metrics", gold.daily_claim_metrics(fact))
    keep("gold", "high_risk_claims", gold.high_risk_claims(fact).orderBy(*gold.by_risk()))
    return tables


def run_pipeline(
    spark: SparkSession,
    lake: Lake,
    *,
    source: str | None = None,
    max_rejection_rate: float = quality.MAX_REJECTION_RATE,
    run_id: str | None = None,
) -> RunReport:
    """Build a candidate run and publish it only when all tests and checks pass.

    `source` is the folder of raw lines the rejection rate is measured against; without one
    the rows of the ingest log are used. A failing run leaves the published tables as they
    were and raises `QualityGateError`.
    """
    configure(spark)
    run_id = run_id or uuid.uuid4().hex
    bronze = {entity: read_entity(spark, lake.bronze, entity) for entity in schemas.ENTITIES}
    tables = build_run(lake, run_id, bronze)

    results = quality.data_tests(tables).where("failures > 0").collect()  # fifteen rows at most
    failed = [(r["table"], r["test"], r["failures"]) for r in results]
    if failed:
        raise quality.QualityGateError(f"data tests failed in run {run_id}: {failed}")

    if source is not None:
        source_rows = line_count(spark, source)
        rejected = line_count(spark, f"{lake.dead_letters}/*")
    else:
        logged = spark.read.parquet(lake.batch_metrics).agg(F.sum("source_rows"), F.sum("rejected")).first()
        source_rows, rejected = logged[0] or 0, logged[1] or 0
    report = quality.slo_report(
        tables["fct_claims_current"], F.lit(source_rows), F.lit(rejected), max_rejection_rate
    )
    path = f"{lake.reports}/{run_id}"
    write_report(report, path)
    status = spark.read.schema(report.schema).json(path).first()["status"]
    if status != "pass":
        raise quality.QualityGateError(f"service-level checks failed in run {run_id}: see {path}")
    publish_run(spark, lake, run_id)
    register_tables(spark, lake, run_id, TABLES)
    return RunReport(run_id, True, failed, status)
