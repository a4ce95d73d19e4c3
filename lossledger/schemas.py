"""Event contracts and table schemas.

The field names, bounds and enumerations are fixed values of the claims data model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Largest amount that the decimal(18,2) of the models surely holds.
MAX_AMOUNT = 9e15

TEXT, NUMBER, WHOLE, DAY, INSTANT, OBJECT = "text", "number", "whole", "day", "instant", "object"


@dataclass(frozen=True)
class Field:
    """One contract field: its type and the bounds a valid value keeps."""

    name: str
    kind: str = TEXT
    min_len: int | None = None
    max_len: int | None = None
    above: float | None = None
    at_least: float | None = None
    at_most: float | None = None
    choices: tuple[str, ...] = ()
    pattern: str | None = None
    email: bool = False
    pii: bool = False
    has_default: bool = False
    offset_required: bool = False

    @property
    def stored_name(self) -> str:
        """Column name in Bronze: personal data is kept only as a token."""
        return f"{self.name}_token" if self.pii else self.name


ENTITIES = ("policy", "claim", "payment")

# Java's `$` would accept a trailing newline; `\z` is the end of the whole string.
EVENT_TYPE_PATTERN = r"^(policy|claim|payment)\.[a-z_]+\z"

DEFAULT_EVENT_VERSION = 1
# Recorded when an event names no producer. Set it to the name your upstream registers.
DEFAULT_PRODUCER = "unnamed-producer"

ENVELOPE = (
    Field("event_id", min_len=8),
    Field("event_type", pattern=EVENT_TYPE_PATTERN),
    Field("event_version", WHOLE, at_least=1, has_default=True),
    Field("occurred_at", INSTANT, offset_required=True),
    Field("producer", has_default=True),
    Field("correlation_id", min_len=8),
    Field("payload", OBJECT),
)

POLICY_STATUSES = ("active", "cancelled", "expired")
CLAIM_STATUSES = ("open", "investigating", "approved", "denied", "closed")

PAYLOADS: dict[str, tuple[Field, ...]] = {
    "policy": (
        Field("policy_id"),
        Field("customer_id"),
        Field("customer_name", pii=True),
        Field("customer_email", email=True, pii=True),
        Field("line_of_business"),
        Field("state", min_len=2, max_len=2),
        Field("effective_date", DAY),
        Field("expiration_date", DAY),
        Field("annual_premium", NUMBER, above=0, at_most=MAX_AMOUNT),
        Field("coverage_limit", NUMBER, above=0, at_most=MAX_AMOUNT),
        Field("deductible", NUMBER, at_least=0, at_most=MAX_AMOUNT),
        Field("status", choices=POLICY_STATUSES),
    ),
    "claim": (
        Field("claim_id"),
        Field("policy_id"),
        Field("claimant_name", pii=True),
        Field("claimant_email", email=True, pii=True),
        Field("loss_date", DAY),
        Field("reported_at", INSTANT),
        Field("claim_type"),
        Field("state", min_len=2, max_len=2),
        Field("reserve_amount", NUMBER, at_least=0, at_most=MAX_AMOUNT),
        Field("paid_amount", NUMBER, at_least=0, at_most=MAX_AMOUNT),
        Field("status", choices=CLAIM_STATUSES),
        Field("adjuster_id"),
        Field("severity", WHOLE, at_least=1, at_most=5),
        Field("source_system"),
    ),
    "payment": (
        Field("payment_id"),
        Field("claim_id"),
        Field("payment_date", DAY),
        Field("amount", NUMBER, above=0, at_most=MAX_AMOUNT),
        Field("payment_type"),
        Field("payee_name", pii=True),
        Field("payment_status"),
    ),
}

PII_FIELDS = tuple(f.name for fields in PAYLOADS.values() for f in fields if f.pii)

# Position of a record in its source; orders records that share one arrival time.
SOURCE_POS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)

ENVELOPE_COLUMNS = (
    "event_id",
    "event_type",
    "event_version",
    "occurred_at",
    "producer",
    "correlation_id",
    "ingested_at",
)

# Bronze keeps dates and reported_at as ISO text and money as double.
_STORED_TYPE = {
    TEXT: T.StringType(),
    NUMBER: T.DoubleType(),
    WHOLE: T.LongType(),
    DAY: T.StringType(),
    INSTANT: T.StringType(),
}

_ENVELOPE_TYPES = {
    "event_version": T.LongType(),
    "occurred_at": T.TimestampType(),
    "ingested_at": T.TimestampType(),
}

PARTITION_COLUMNS = ("entity", "event_date", "batch_id")


def payload_columns(entity: str) -> list[str]:
    return [f.stored_name for f in PAYLOADS[entity]]


def bronze_columns(entity: str) -> list[str]:
    """File columns of one Bronze entity, without the partition columns."""
    return [*ENVELOPE_COLUMNS, *payload_columns(entity), "source_pos"]


def bronze_schema(entity: str) -> T.StructType:
    fields = [T.StructField(c, _ENVELOPE_TYPES.get(c, T.StringType())) for c in ENVELOPE_COLUMNS]
    fields += [T.StructField(f.stored_name, _STORED_TYPE[f.kind]) for f in PAYLOADS[entity]]
    fields.append(T.StructField("source_pos", SOURCE_POS))
    fields += [
        T.StructField("entity", T.StringType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("batch_id", T.StringType()),
    ]
    return T.StructType(fields)


ERROR_ITEM = T.StructType(
    [T.StructField("field", T.StringType()), T.StructField("error", T.StringType())]
)

DEAD_LETTER_SCHEMA = T.StructType(
    [
        T.StructField("reason", T.StringType()),
        T.StructField("raw", T.StringType()),
        # Set only for records that are not UTF-8, whose `raw` has replacement characters.
        T.StructField("raw_base64", T.StringType()),
        T.StructField("error_class", T.StringType()),
        T.StructField("errors", T.ArrayType(ERROR_ITEM)),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_version", T.LongType()),
        T.StructField("producer", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("batch_id", T.StringType()),
    ]
)
