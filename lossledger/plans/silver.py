"""Silver: typed staging, policy history and the current-claim fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.functions.numbers import MONEY_TOTAL, money
from lossledger.operators.dedup import latest_by, latest_event
from lossledger.operators.history import HEAVY_MIN_ROWS, HEAVY_SHARE, with_next_instant
from lossledger.operators.stored_events import PLACE, StoredEvents, placed

# Fixed values of the risk model.
SEVERITY_POINTS = 15
LATE_REPORT_DAYS, LATE_REPORT_POINTS = 7, 15
HIGH_RESERVE_SHARE, HIGH_RESERVE_POINTS = "0.5", 10
PARTNER_SOURCE, PARTNER_POINTS = "partner_api", 5
MAX_RISK = 100
VOID = "void"

# Bronze columns that staging leaves out.
UNSTAGED = ("event_version", "producer", "correlation_id", "entity", "event_date")


def _instant(name: str) -> Column:
    return F.col(name).cast("timestamp").alias(name)


def _policy_columns() -> list[Column | str]:
    return [
        "event_id",
        "event_type",
        _instant("occurred_at"),
        _instant("ingested_at"),
        "policy_id",
        "customer_id",
        "customer_name_token",
        "customer_email_token",
        "line_of_business",
        "state",
        F.col("effective_date").cast("date").alias("effective_date"),
        F.col("expiration_date").cast("date").alias("expiration_date"),
        money("annual_premium").alias("annual_premium"),
        money("coverage_limit").alias("coverage_limit"),
        money("deductible").alias("deductible"),
        "status",
    ]


def stg_policies(bronze: DataFrame) -> DataFrame:
    """One typed row per policy event."""
    return latest_event(bronze).select(*_policy_columns())


def _claim_columns() -> list[Column | str]:
    return [
        "event_id",
        "event_type",
        _instant("occurred_at"),
        _instant("ingested_at"),
        "claim_id",
        "policy_id",
        "claimant_name_token",
        "claimant_email_token",
        F.col("loss_date").cast("date").alias("loss_date"),
        _instant("reported_at"),
        "claim_type",
        "state",
        money("reserve_amount").alias("reserve_amount"),
        money("paid_amount").alias("reported_paid_amount"),
        "status",
        "adjuster_id",
        F.col("severity").cast("int").alias("severity"),
        "source_system",
    ]


def stg_claims(bronze: DataFrame) -> DataFrame:
    """One typed row per claim event."""
    return latest_event(bronze).select(*_claim_columns())


def stg_payments(bronze: DataFrame) -> DataFrame:
    """One typed row per payment event."""
    return latest_event(bronze).select(
        "event_id",
        "event_type",
        _instant("occurred_at"),
        _instant("ingested_at"),
        "payment_id",
        "claim_id",
        F.col("payment_date").cast("date").alias("payment_date"),
        money("amount").alias("amount"),
        "payment_type",
        "payee_name_token",
        "payment_status",
    )


_POLICY_ATTRIBUTES = (
    "policy_id",
    "customer_id",
    "customer_name_token",
    "customer_email_token",
    "line_of_business",
    "state",
    "effective_date",
    "expiration_date",
    "annual_premium",
    "coverage_limit",
    "deductible",
    "status",
)


def _version_key() -> Column:
    # Text form of a UTC timestamp with its offset; any null part makes the key null.
    return F.md5(
        F.concat(F.col("policy_id"), F.lit("|"), F.col("occurred_at").cast("string"), F.lit("+00"))
    )


def dim_policy_history(
    policies: DataFrame,
    *,
    weigh: DataFrame | None = None,
    share: float = HEAVY_SHARE,
    min_rows: int = HEAVY_MIN_ROWS,
) -> DataFrame:
    """Every policy event as a version, valid until the next one of its policy."""
    versions = with_next_instant(
        policies,
        "policy_id",
        "occurred_at",
        "event_id",
        "valid_to",
        weigh=weigh,
        share=share,
        min_rows=min_rows,
    )
    return as_history(versions)


def as_history(versions: DataFrame) -> DataFrame:
    """Staged policy events with the end of their intervals (`valid_to`) as versions."""
    return versions.select(
        _version_key().alias("policy_version_key"),
        *_POLICY_ATTRIBUTES,
        F.col("occurred_at").alias("valid_from"),
        "valid_to",
        F.col("valid_to").isNull().alias("is_current"),
    )


def stored_policy_history(
    events: StoredEvents, *, share: float = HEAVY_SHARE, min_rows: int = HEAVY_MIN_ROWS
) -> DataFrame:
    """`dim_policy_history` of stored policy events: the intervals are found on the columns that make them."""
    found = events.newest("policy_id", _instant("occurred_at"))
    spaced = with_next_instant(
        found, "policy_id", "occurred_at", "event_id", "valid_to", weigh=events.rows, share=share, min_rows=min_rows
    )
    return as_history(events.joined(placed(spaced).select(*PLACE, "valid_to"), *_policy_columns()))


def dim_policy_current(history: DataFrame) -> DataFrame:
    """The open version of each policy, from the stored history."""
    return history.where("is_current").drop("valid_to", "is_current")


def latest_policy(policies: DataFrame) -> DataFrame:
    """The same rows as `dim_policy_current`, straight from staging.

    A version is open when no later one exists, so a top-1 per policy is enough and the
    intervals of all other versions need not be built.
    """
    newest = latest_by(policies, "policy_id", [F.desc("occurred_at"), F.desc("event_id")])
    return newest.select(
        _version_key().alias("policy_version_key"),
        *_POLICY_ATTRIBUTES,
        F.col("occurred_at").alias("valid_from"),
    )


def latest_claim(claims: DataFrame) -> DataFrame:
    """The last event of each claim in event time."""
    return latest_by(claims, "claim_id", [F.desc("occurred_at"), F.desc("event_id")])


def _latest_places(events: StoredEvents, *columns: str) -> DataFrame:
    """Claim id, place and `columns` of the last event of each claim."""
    return placed(latest_claim(events.newest("claim_id", _instant("occurred_at"), *columns)))


def stored_latest_claim(events: StoredEvents) -> DataFrame:
    """`latest_claim` of stored claim events."""
    return events.joined(_latest_places(events).select(*PLACE), *_claim_columns())


def payments_by_claim(payments: DataFrame) -> DataFrame:
    """Sum and number of the payments of a claim that were not voided."""
    counted = F.col("payment_status") != VOID
    return payments.groupBy("claim_id").agg(
        F.sum(F.when(counted, F.col("amount")).otherwise(0))
        .cast(MONEY_TOTAL)
        .alias("cleared_payment_amount"),
        F.count(F.when(counted, 1)).alias("payment_count"),
    )


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def fct_claims_current(claims: DataFrame, payments: DataFrame, current_policy: DataFrame) -> DataFrame:
    """Current state of each claim with its policy, payments and risk score.

    Payments are joined first: they share the claim-id partitioning of the latest claims, so
    only the policy join moves the claims again (or not at all when policies are small).
    """
    joined = _with_figures(latest_claim(claims), payments, current_policy)
    return with_measures(joined.select(*claims.columns, *_FIGURES))


_FIGURES = ("line_of_business", "coverage_limit", "cleared_payment_amount", "payment_count")


def _with_figures(claim: DataFrame, payments: DataFrame, current_policy: DataFrame) -> DataFrame:
    """Claims with their payments and their policy's line and limit."""
    paid = payments_by_claim(payments)
    policy = current_policy.select("policy_id", "line_of_business", "coverage_limit")
    cleared = F.coalesce("cleared_payment_amount", F.lit(0).cast(MONEY_TOTAL))
    joined = claim.join(paid, "claim_id", "left").join(policy, "policy_id", "left")
    return joined.withColumns(
        {"cleared_payment_amount": cleared, "payment_count": F.coalesce("payment_count", F.lit(0).cast("bigint"))}
    )


def stored_claims_current(events: StoredEvents, payments: DataFrame, current_policy: DataFrame) -> DataFrame:
    """`fct_claims_current` of stored claim events: payments and policies meet a claim's ids, not its whole row."""
    found = _with_figures(_latest_places(events, "policy_id"), payments, current_policy)
    return with_measures(events.joined(found.select(*PLACE, *_FIGURES), *_claim_columns()))


def with_measures(claims: DataFrame) -> DataFrame:
    """Claims with their policy's line and limit and their payments, and the figures that follow."""
    measured = claims.withColumns(
        {
            "paid_amount": F.greatest(F.col("reported_paid_amount").cast(MONEY_TOTAL), "cleared_payment_amount"),
            "outstanding_reserve": F.greatest(
                (F.col("reserve_amount") - F.col("reported_paid_amount")).cast(MONEY_TOTAL),
                F.lit(0).cast(MONEY_TOTAL),
            ),
            "reporting_delay_days": F.datediff(F.to_date("reported_at"), "loss_date").cast("bigint"),
        }
    )
    half_limit = F.col("coverage_limit") * F.lit(HIGH_RESERVE_SHARE).cast("decimal(2,1)")
    risk = (
        F.col("severity") * SEVERITY_POINTS
        + _points(F.col("reporting_delay_days") > LATE_REPORT_DAYS, LATE_REPORT_POINTS)
        + _points(F.col("reserve_amount") > half_limit, HIGH_RESERVE_POINTS)
        + _points(F.col("source_system") == PARTNER_SOURCE, PARTNER_POINTS)
    )
    return measured.select(
        *claims.columns,
        "paid_amount",
        "outstanding_reserve",
        "reporting_delay_days",
        (F.col("paid_amount") + F.col("outstanding_reserve")).cast(MONEY_TOTAL).alias("total_incurred"),
        F.least(F.lit(MAX_RISK), risk).cast("int").alias("risk_score"),
    )
