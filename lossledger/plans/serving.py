"""Read-only queries over the Gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.functions.numbers import MONEY_TOTAL
from lossledger.plans.gold import by_risk

# The choice that stands for all lines, rows of the attention list, and, below, the columns
# and limits of each view.
ALL_LINES = "All"
ATTENTION_ROWS = 100


def _bounded(limit: int, largest: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= largest:
        raise ValueError(f"limit must be a whole number from 1 to {largest}, not {limit!r}")
    return limit


def kpis(claims_kpis: DataFrame) -> DataFrame:
    return claims_kpis


def kpi_cards(claims_kpis: DataFrame) -> DataFrame:
    """The four headline cards and the data-as-of time."""
    return claims_kpis.select(
        "total_claims", "open_claims", "total_incurred", "high_risk_claims", "data_as_of"
    )


def run_summary(claims_kpis: DataFrame) -> DataFrame:
    """What a finished run reports."""
    return kpi_cards(claims_kpis)


def work_queue(high_risk: DataFrame) -> DataFrame:
    """The whole review queue in work order."""
    return high_risk.orderBy(*by_risk())


def top_risk(high_risk: DataFrame, limit: int = 25) -> DataFrame:
    """The `limit` (1 to 500) riskiest claims; sort and limit run as one top-k."""
    return high_risk.orderBy(*by_risk()).limit(_bounded(limit, 500))


def daily_metrics(
    daily: DataFrame, state: str | None = None, line_of_business: str | None = None, limit: int = 250
) -> DataFrame:
    """The newest daily rows (1 to 5000), optionally of one state or line."""
    if state is not None and state != "" and len(state) != 2:
        raise ValueError("state must have two letters")
    rows = daily
    if state:
        rows = rows.where(F.col("state") == state.upper())
    if line_of_business:
        rows = rows.where(F.col("line_of_business") == line_of_business)
    newest = [F.desc_nulls_last("loss_date"), F.asc_nulls_last("line_of_business"), F.asc_nulls_last("state")]
    return rows.orderBy(*newest).limit(_bounded(limit, 5_000))


def lines_of_business(daily: DataFrame) -> DataFrame:
    """The choices of the line filter: every line in order, after the choice of all."""
    spark = daily.sparkSession
    lines = daily.select("line_of_business").na.drop().distinct()
    everything = spark.range(1).select(F.lit(ALL_LINES).alias("line_of_business"), F.lit(0).alias("_group"))
    return (
        lines.withColumn("_group", F.lit(1))
        .unionByName(everything)
        .orderBy("_group", "line_of_business")
        .drop("_group")
    )


def volume_by_loss_date(daily: DataFrame, line: str = ALL_LINES) -> DataFrame:
    """Claims and incurred per loss date, for all lines or one."""
    rows = daily if line == ALL_LINES else daily.where(F.col("line_of_business") == line)
    return (
        rows.where("loss_date is not null")
        .groupBy("loss_date")
        .agg(
            F.sum("claim_count").alias("claim_count"),
            F.sum("total_incurred").cast(MONEY_TOTAL).alias("total_incurred"),
        )
        .orderBy("loss_date")
    )


def incurred_by_line(daily: DataFrame) -> DataFrame:
    """Incurred per line; claims without a line are left out of this chart."""
    return (
        daily.where("line_of_business is not null")
        .groupBy("line_of_business")
        .agg(F.sum("total_incurred").cast(MONEY_TOTAL).alias("total_incurred"))
        .orderBy("line_of_business")
    )


def attention_list(high_risk: DataFrame) -> DataFrame:
    """The claims a supervisor sees first."""
    return top_risk(high_risk, ATTENTION_ROWS).select(
        "claim_id",
        "line_of_business",
        "state",
        "status",
        "severity",
        "risk_score",
        "total_incurred",
        "adjuster_id",
    )
