"""Gold: KPI row, daily metrics and the high-risk queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.functions.numbers import MONEY_TOTAL, round_half_up

SETTLED = ("closed", "denied")
HIGH_RISK = 70

HIGH_RISK_COLUMNS = (
    "claim_id",
    "policy_id",
    "loss_date",
    "reported_at",
    "line_of_business",
    "state",
    "status",
    "severity",
    "reporting_delay_days",
    "reserve_amount",
    "paid_amount",
    "total_incurred",
    "risk_score",
    "adjuster_id",
    "source_system",
)


def _total(name: str) -> Column:
    return F.round(F.sum(name), 2).cast(MONEY_TOTAL)


def is_open() -> Column:
    """Whether a claim is neither closed nor denied."""
    return ~F.col("status").isin(*SETTLED)


def claims_kpis(fact: DataFrame) -> DataFrame:
    """One row of headline figures."""
    return fact.agg(
        F.count("*").alias("total_claims"),
        F.count_if(is_open()).alias("open_claims"),
        _total("total_incurred").alias("total_incurred"),
        _total("paid_amount").alias("total_paid"),
        _total("outstanding_reserve").alias("outstanding_reserve"),
        F.count_if(F.col("risk_score") >= HIGH_RISK).alias("high_risk_claims"),
        round_half_up(F.avg("reporting_delay_days"), 2).alias("avg_reporting_delay_days"),
        F.max("occurred_at").alias("data_as_of"),
    )


def daily_claim_metrics(fact: DataFrame) -> DataFrame:
    """Measures per loss date, line and state; claims without a policy form their own line."""
    return fact.groupBy("loss_date", "line_of_business", "state").agg(
        F.count("*").alias("claim_count"),
        F.count_if(is_open()).alias("open_claim_count"),
        _total("paid_amount").alias("paid_amount"),
        _total("outstanding_reserve").alias("outstanding_reserve"),
        _total("total_incurred").alias("total_incurred"),
        round_half_up(F.avg("risk_score"), 2).alias("avg_risk_score"),
    )


def by_risk() -> list[Column]:
    """Order of the work queue; the claim id makes it total."""
    return [F.desc_nulls_last("risk_score"), F.desc_nulls_last("total_incurred"), F.asc("claim_id")]


def high_risk_claims(fact: DataFrame) -> DataFrame:
    """The review queue, unsorted: readers order it themselves (see plans.serving)."""
    return fact.where(F.col("risk_score") >= HIGH_RISK).select(*HIGH_RISK_COLUMNS)
