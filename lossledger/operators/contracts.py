"""Contract checks over raw event records.

`check` turns lines of text into typed event columns plus two error lists, one for the
envelope and one for the payload, because known event ids are recognised between the two.
Nothing is dropped: every input row leaves as one output row.

Most records are plain: their text has known keys only, each with a value in its usual form and no
escapes, in any order. One pattern over the text tells, `from_json` reads the values, and a record that
keeps every bound is done. The others are parsed as documents. Those that spell every field in the usual way
are recognised by comparing the type signature of the whole document with the few usual ones, which settles
unknown keys, missing keys and types in one comparison; the lenient rules run only for what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger import schemas
from lossledger.functions import variants
from lossledger.operators.settle import settled
from lossledger.schemas import DAY, INSTANT, NUMBER, OBJECT, TEXT, WHOLE, Field

# Class names under which rejects are counted.
DECODE_ERROR, JSON_ERROR, CONTRACT_ERROR = "UnicodeDecodeError", "JSONDecodeError", "ValidationError"

LAX, STRICT = "lax", "strict"

ACCEPTED, REJECTED, DUPLICATE = "accepted", "rejected", "duplicate"

_TYPING = {
    TEXT: variants.text,
    NUMBER: variants.number,
    WHOLE: variants.whole,
    DAY: variants.day,
    INSTANT: variants.instant,
}

# The usual spelling of each kind: its JSON type in a signature, and as a Spark type.
_NUMBER = r"(BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\))"
_SIGNATURE = {TEXT: "STRING", NUMBER: _NUMBER, WHOLE: "BIGINT", DAY: "STRING", INSTANT: "STRING"}
_SPARK_TYPE = {TEXT: "string", NUMBER: "double", WHOLE: "bigint", DAY: "string", INSTANT: "string"}

_USUAL_DAY = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
# Offsets up to 18 hours, the range a timestamp cast reads; the iso text needs no rewriting.
_USUAL_INSTANT = (
    r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"(\.(?!000000)[0-9]{6})?(Z|(?!-00:00)[+-](0[0-9]|1[0-7]):[0-5][0-9])\z"
)
_BLANK = r"[ \t\r\n]*"


def _inside(pattern: str) -> str:
    """A pattern without its anchors."""
    return pattern.removeprefix("^").removesuffix(r"\z")


def _payload_fields() -> list[Field]:
    """Each payload field once; fields two entities share have the same type in both."""
    seen: dict[str, Field] = {}
    for fields in schemas.PAYLOADS.values():
        for field in fields:
            if seen.setdefault(field.name, field).kind != field.kind:
                raise ValueError(f"{field.name} has two types")
    return list(seen.values())


PAYLOAD_FIELDS = _payload_fields()
ENVELOPE_FIELDS = [f for f in schemas.ENVELOPE if f.kind != OBJECT]
SCALAR_FIELDS = [*ENVELOPE_FIELDS, *PAYLOAD_FIELDS]


def _usual_signature() -> str:
    """Pattern of the type signature of a complete document; signatures list keys in order."""

    def members(types: dict[str, str], optional: set[str] = frozenset()) -> str:
        listed = "".join(
            f"({name}: {types[name]}, )?" if name in optional else f"{name}: {types[name]}, "
            for name in sorted(types)
        )
        return f"OBJECT<{listed}>"

    payloads = [
        members({f.name: _SIGNATURE[f.kind] for f in fields}) for fields in schemas.PAYLOADS.values()
    ]
    types = {f.name: _SIGNATURE[f.kind] for f in ENVELOPE_FIELDS} | {"payload": f"({'|'.join(payloads)})"}
    return f"^{members(types, {f.name for f in ENVELOPE_FIELDS if f.has_default})}\\z"


def _document_signature(document: Column) -> Column:
    """`OBJECT<key: TYPE, ... >` with a separator after every member."""
    return F.replace(F.schema_of_variant(document), F.lit(">"), F.lit(", >"))


def _struct_fields() -> str:
    def columns(fields: list[Field]) -> str:
        return ",".join(f"{f.name}:{_SPARK_TYPE[f.kind]}" for f in fields)

    return f"{columns(ENVELOPE_FIELDS)},payload:struct<{columns(PAYLOAD_FIELDS)}>"


def _spelled(root: str, field: Field) -> str:
    """Name of the field as the document spelled it, in the struct `root`."""
    return f"{root}.{field.name}" if field in ENVELOPE_FIELDS else f"{root}.payload.{field.name}"


def _usual_value(field: Field) -> Column:
    return F.col(_spelled("_usual", field))


def _all_usual_times() -> Column:
    """Every day and instant of the document has its usual form."""
    usual = F.lit(True)
    for field in SCALAR_FIELDS:
        if field.kind in (DAY, INSTANT):
            value = _usual_value(field)
            pattern = _USUAL_DAY if field.kind == DAY else _USUAL_INSTANT
            usual = usual & (value.isNull() | value.rlike(pattern))
    return usual


def _own_payload() -> Column:
    """The payload is that of the entity which the event type names.

    A usual payload has all fields of one entity, so one field that only this entity has tells.
    """
    entity = F.split_part(F.col("_usual.event_type"), F.lit("."), F.lit(1))
    own = F.lit(True)
    for name, fields in schemas.PAYLOADS.items():
        others = {f.name for e, more in schemas.PAYLOADS.items() if e != name for f in more}
        mark = next(f.name for f in fields if f.name not in others)
        own = F.when(entity == name, F.col(f"_usual.payload.{mark}").isNotNull()).otherwise(own)
    return own


def usual_instant(value: Column) -> Column:
    """`variants.instant` of a text of the usual form."""
    at = value.try_cast("timestamp")
    iso = F.when(value.endswith("Z"), F.concat(F.substring_index(value, "Z", 1), F.lit("+00:00"))).otherwise(value)
    return F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(True).alias("aware"), iso.alias("iso")))


def _from_usual(field: Field, root: str = "_usual") -> Column:
    value = F.col(_spelled(root, field))
    if field.kind == DAY:
        return F.when(value.try_cast("date").isNotNull(), value)
    if field.kind == INSTANT:
        return usual_instant(value)
    return value + F.lit(0.0) if field.kind == NUMBER else value


#: Longer texts are not looked at as plain ones; documents have limits of their own far above.
PLAIN_BYTES = 1 << 20
# More members than any object of the contracts has; bounds the depth of the pattern's matching.
_MEMBERS = 40

# Forms of plain values. The digits of a whole number fit 64 bits; `from_json` refuses what JSON doesn't allow.
_PLAIN_FORM = {
    TEXT: r'"[^"\\]*"',
    NUMBER: r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?",
    WHOLE: r"-?[0-9]{1,18}+(?![0-9.eE])",
    DAY: f'"{_inside(_USUAL_DAY)}"',
    INSTANT: f'"{_inside(_USUAL_INSTANT)}"',
}


def _plain_text() -> str:
    """Pattern of a text that is one object of known keys and plain values, its payload with those of one entity."""

    def members(forms: dict[str, str]) -> str:
        one = "(?>" + "|".join(f'{name}"{_BLANK}:{_BLANK}{form}' for name, form in forms.items()) + ")"
        return rf'\{{{_BLANK}"{one}(?>{_BLANK},{_BLANK}"{one}){{0,{_MEMBERS}}}+{_BLANK}\}}'

    def form(field: Field) -> str:
        return f'"{_inside(field.pattern)}"' if field.pattern else _PLAIN_FORM[field.kind]

    payloads = [members({f.name: form(f) for f in fields}) for fields in schemas.PAYLOADS.values()]
    envelope = {f.name: form(f) for f in ENVELOPE_FIELDS} | {"payload": f"(?>{'|'.join(payloads)})"}
    return f"^{_BLANK}{members(envelope)}{_BLANK}\\z"


def read_plain(records: DataFrame, schema: str) -> DataFrame:
    """Add `_plain`, the fields of `schema` in records with a plain text; null for other records.

    A plain text that JSON does not allow (a control character, a number with leading zeros) leaves the text in
    `_plain._broken`. Known keys and types are settled, except that keys may be missing; of
    repeated keys, all plain, the last counts.
    """
    # The order matters: the pattern is for decoded text.
    plain = F.is_valid_utf8("value") & (F.octet_length("value") <= PLAIN_BYTES) & F.col("value").rlike(_plain_text())
    read = F.from_json("value", f"struct<{schema},_broken:string>", {"columnNameOfCorruptRecord": "_broken"})
    return settled(records.withColumn("_plain", F.when(plain, read)))


def parse(records: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Decode and parse `value`; adds `_decoded` and `_document`, the JSON document of a record.

    Only records that are `wanted` are parsed, by default all; the document of others is null.

    The document is null when the record is not exactly one. The parser stops after the first document
    of a text, so the record is parsed as the first item of an array whose second item is the
    record's own hash: text after the document moves or hides the hash.
    """
    stamp = F.xxhash64("value").cast("string")
    pair = F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit(',"'), stamp, F.lit('"]')))
    whole = F.try_variant_get("_pair", "$[1]", "string") == stamp
    decoded = F.col("_decoded") if wanted is None else wanted & F.col("_decoded")
    return (
        records.withColumn("_decoded", F.is_valid_utf8("value"))
        .withColumn("_pair", F.when(decoded, pair))
        .withColumn("_document", F.when(whole, F.try_variant_get("_pair", "$[0]", "variant")))
        .drop("_pair")
    )


_BUILT: dict[tuple, Any] = {}


def _once(key: tuple, build: Callable[[], Any]) -> Any:
    """Columns built once for each driver; they name columns, so they fit every batch.

    Building them takes thousands of calls into the driver's JVM, which would be the larger part
    of a small micro-batch.
    """
    slot = (id(SparkContext._gateway), *key)
    if slot not in _BUILT:
        _BUILT[slot] = build()
    return _BUILT[slot]


def _typed(records: DataFrame) -> DataFrame:
    """Add `_typed` for records that are not sound: a typed value per field, null when absent or of another type.

    Also `_is_usual`, and for the other records the members of envelope and payload. All of it is null for
    sound records, so that they carry no columns through the steps that are not for them.
    """
    typed = parse(records, ~F.col("_whole"))
    for step in _once(("typed",), _typing_steps):
        typed = typed.withColumns(step)
    return typed.drop("_known", "_usual", "_lenient")


def _of_plain(rule: Callable[[Field], str]) -> Column:
    """Whether a plain text meets an SQL rule for all fields of its envelope and its payload."""

    def all_of(fields: list[Field]) -> str:
        return " and ".join(f"({rule(f)})" for f in fields)

    payload = " ".join(
        f"when startswith(_plain.event_type, '{entity}.') then {all_of(list(fields))}"
        for entity, fields in schemas.PAYLOADS.items()
    )
    return F.expr(f"{all_of(ENVELOPE_FIELDS)} and case {payload} else false end")


def _whole() -> Column:
    """Whether a plain text has all keys of its envelope and its payload, which makes it a usual document."""
    there = _of_plain(lambda f: "true" if f.has_default else f"{_spelled('_plain', f)} is not null")
    return F.coalesce(F.col("_plain").isNotNull() & F.col("_plain._broken").isNull() & there, F.lit(False))


def _sound(strict: bool) -> Column:
    """Whether a plain text that is whole keeps every bound; its days and instants exist."""

    def kept(field: Field) -> str:
        value = _spelled("_plain", field)
        real = {DAY: f"try_cast({value} as date)", INSTANT: f"try_cast({value} as timestamp)"}.get(field.kind, value)
        bounds = f"{real} is not null and {_violation(field, value, usual=True)} is null"
        return f"{value} is null or ({bounds})" if field.has_default and not strict else bounds

    named = F.length("_plain.producer") >= 1 if strict else F.lit(True)
    return F.coalesce(F.col("_whole") & _of_plain(kept) & named, F.lit(False))


def _typing_steps() -> list[dict[str, Column]]:
    """The columns that `_typed` adds, each step on top of the ones before."""
    document = F.col("_document")
    steps = [
        {"_known": F.coalesce(_document_signature(document).rlike(_usual_signature()), F.lit(False))},
        # The text is read again with the types that the signature has settled, which is cheaper than casting
        # each member of the document; adding zero leaves out the sign of a zero, as the document does.
        {
            "_usual": F.when(F.col("_whole") & ~F.col("_sound"), F.col("_plain").dropFields("_broken")).when(
                F.col("_known"), F.from_json("value", f"struct<{_struct_fields()}>")
            )
        },
        {"_is_usual": F.col("_whole") | (F.col("_known") & _own_payload() & _all_usual_times())},
        {"_envelope": F.when(~F.col("_is_usual"), variants.members(document))},
        {"_payload": variants.members(F.try_element_at("_envelope", F.lit("payload")))},
    ]

    def named(fields: list[Field], name: Column) -> Column:
        return name.isin([f.name for f in fields])

    outer = F.map_filter("_envelope", lambda k, v: named(ENVELOPE_FIELDS, k))
    inner = F.map_filter("_payload", lambda k, v: named(PAYLOAD_FIELDS, k))
    members = F.when(F.col("_payload").isNull(), outer).otherwise(F.map_concat(outer, inner))
    cells = F.transform_values(members, lambda k, v: variants.cell(v))
    steps.append({"_cells": F.when(F.col("_envelope").isNotNull(), cells)})

    def lenient(kind: str) -> Column:
        of_kind = [f for f in SCALAR_FIELDS if f.kind == kind]
        chosen = F.map_filter("_cells", lambda k, v: named(of_kind, k))
        return F.transform_values(chosen, lambda k, c: _TYPING[kind](c["type"], c["text"])).alias(kind)

    steps.append({"_lenient": F.when(F.col("_cells").isNotNull(), F.struct(*map(lenient, _TYPING)))})
    typed = [
        F.when(F.col("_is_usual"), _from_usual(f))
        .otherwise(F.try_element_at(F.col("_lenient")[f.kind], F.lit(f.name)))
        .alias(f.name)
        for f in SCALAR_FIELDS
    ]
    steps.append({"_typed": F.when(~F.col("_sound"), F.struct(*typed))})
    return steps


def _violation(field: Field, value: str, usual: bool = False) -> str:
    """SQL: text of the first bound the typed `value` breaks, else null; a plain one is of the form `usual`."""
    # Spark orders NaN above every number; a bound must fail it.
    nan = f"isnan({value}) or " if field.kind == NUMBER else ""
    rules: list[tuple[str, str]] = []
    if field.min_len is not None:
        rules.append((f"length({value}) < {field.min_len}", f"shorter than {field.min_len}"))
    if field.max_len is not None:
        rules.append((f"length({value}) > {field.max_len}", f"longer than {field.max_len}"))
    if field.pattern is not None and not usual:
        rules.append((f"not {value} rlike r'{field.pattern}'", "does not match the pattern"))
    if field.choices:
        listed = ", ".join(f"'{c}'" for c in field.choices)
        rules.append((f"{value} not in ({listed})", "not one of " + ", ".join(field.choices)))
    if field.email:
        rules.append((f"not contains({value}, '@')", "not an email address"))
    if field.offset_required and not usual:
        rules.append((f"not {value}.aware", "has no time zone offset"))
    if field.above is not None:
        rules.append((f"{nan}{value} <= {field.above}", f"not above {field.above:g}"))
    if field.at_least is not None:
        rules.append((f"{nan}{value} < {field.at_least}", f"below {field.at_least:g}"))
    if field.at_most is not None:
        rules.append((f"{nan}{value} > {field.at_most}", f"above {field.at_most:g}"))
    if not rules:
        return "cast(null as string)"
    return "case " + " ".join(f"when {broken} then '{text}'" for broken, text in rules) + " end"


def _message(field: Field, required: bool) -> Column:
    """Text of what is wrong with a field, else null."""
    value = f"_typed.{field.name}"
    absent = "'missing'" if required else "cast(null as string)"
    return F.expr(
        f"case when {value} is not null then {_violation(field, value)} "
        f"when not _is_usual and map_contains_key(_cells, '{field.name}') then 'not a valid {field.kind}' "
        f"when _is_usual and {required or field.kind == INSTANT or field.kind == DAY} "
        f"then 'not a valid {field.kind}' "
        f"else {absent} end"
    )


def _error(field: Column, message: Column) -> Column:
    return F.struct(field.alias("field"), message.alias("error"))


def _only(message: str) -> Column:
    return F.array(_error(F.lit(""), F.lit(message)))


def _errors(fields: list[Field], keys: Column, strict: bool, *more: Column) -> Column:
    """All errors of one object: per field, then per unknown key, then `more`.

    `keys` are the keys of an object that is not spelled as usual, else null.
    """
    messages = {f.name: _message(f, strict or not f.has_default) for f in fields}
    known = F.array(*[F.lit(f.name) for f in fields])
    unknown = F.coalesce(F.array_except(keys, known), F.array().cast("array<string>"))
    listed = F.filter(
        F.array(*[_error(F.lit(name), message) for name, message in messages.items()], *more),
        lambda e: e["error"].isNotNull(),
    )
    strange = F.transform(unknown, lambda key: _error(key, F.lit("unknown field")))
    clean = F.coalesce(*messages.values(), *[m["error"] for m in more]).isNull() & (F.size(unknown) == 0)
    return F.when(clean, F.array().cast(f"array<{schemas.ERROR_ITEM.simpleString()}>")).otherwise(
        F.concat(listed, strange)
    )


def _strict_rules() -> list[Column]:
    """Rules of the portable contract that the lenient types let through."""
    at_form = r"^[0-9-]{10}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\z"

    def rule(name: str, broken: Column, message: str) -> Column:
        return _error(F.lit(name), F.when(broken, message))

    cells = F.col("_cells")
    version, at = cells["event_version"]["type"], cells["occurred_at"]
    return [
        rule("producer", F.length("_typed.producer") < 1, "shorter than 1"),
        rule("event_version", version.isin("STRING", "BOOLEAN"), "not a JSON number"),
        rule("occurred_at", at["type"] != "STRING", "not a JSON string"),
        rule("occurred_at", ~at["text"].rlike(at_form), "not an RFC 3339 date-time"),
    ]


def check(
    records: DataFrame, *, mode: str = LAX, default_producer: str = schemas.DEFAULT_PRODUCER
) -> DataFrame:
    """Typed event columns, `entity`, `envelope_errors`, `payload_errors` and `envelope_class`.

    `mode="strict"` applies the portable envelope contract, which has no defaults.
    """
    if mode not in (LAX, STRICT):
        raise ValueError(f"mode must be {LAX!r} or {STRICT!r}, not {mode!r}")
    envelope_errors, entity, payload_errors, stored = _once(
        ("check", mode, default_producer), lambda: _check_columns(mode == STRICT, default_producer)
    )
    read = read_plain(records, _struct_fields())
    read = read.withColumn("_whole", _once(("whole",), _whole))
    read = read.withColumn("_sound", _once(("sound", mode), lambda: _sound(mode == STRICT)))
    events = settled(_typed(read), "_typed").withColumn("envelope_errors", envelope_errors).withColumn("entity", entity)
    # Settled before columns are renamed: constraint inference tries every mix of old and new names.
    events = settled(events.withColumn("payload_errors", payload_errors))
    return settled(events.select(*records.columns, *stored))


def _check_columns(strict: bool, default_producer: str) -> tuple[Column, Column, Column, list[Column]]:
    """Envelope errors, entity, payload errors, and the columns that `check` gives."""
    usual = F.col("_is_usual")
    no_document = F.col("_document").isNull() & ~F.col("_whole")
    is_object = usual | F.col("_envelope").isNotNull()

    payload_form = _error(
        F.lit("payload"),
        F.when(usual | F.col("_payload").isNotNull(), F.lit(None).cast("string"))
        .when(F.try_element_at("_envelope", F.lit("payload")).isNull(), "missing")
        .otherwise("not a valid object"),
    )
    keys = F.array_except(F.map_keys("_envelope"), F.array(F.lit("payload")))
    none = F.array().cast(f"array<{schemas.ERROR_ITEM.simpleString()}>")
    sound = F.col("_sound")
    envelope_errors = (
        F.when(sound, none)
        .when(~F.col("_decoded"), _only("not UTF-8"))
        .when(no_document, _only("not a JSON document"))
        .when(~is_object, _only("not a JSON object"))
        .otherwise(
            _errors(ENVELOPE_FIELDS, keys, strict, payload_form, *(_strict_rules() if strict else []))
        )
    )
    valid = F.size("envelope_errors") == 0
    entity_of = F.when(
        valid, F.split_part(F.when(sound, F.col("_plain.event_type")).otherwise(F.col("_typed.event_type")), F.lit("."), F.lit(1))
    )
    found = F.when(sound, none)
    for entity, contract in schemas.PAYLOADS.items():
        errors = _errors(list(contract), F.map_keys("_payload"), strict=True)
        found = found.when(F.col("entity") == entity, errors)

    by_name = {f.name: f for f in SCALAR_FIELDS}

    def value_of(name: str, part: str | None = None) -> Column:
        plain, other = _from_usual(by_name[name], "_plain"), F.col(f"_typed.{name}")
        return F.when(sound, plain[part] if part else plain).otherwise(other[part] if part else other)

    def defaulted(name: str, default: Column) -> Column:
        # Only an absent key takes the default; an explicit null is an error.
        absent = usual | ~F.map_contains_key("_cells", name)
        return F.when(value_of(name).isNull() & absent, default).otherwise(value_of(name)).alias(name)

    def stored(field: Field) -> Column:
        value = value_of(field.name, "iso" if field.kind == INSTANT else None)
        return (F.lower(value) if field.email else value).alias(field.name)

    return envelope_errors, entity_of, found, [
        F.col("envelope_errors"),
        F.when(sound, F.lit(None).cast("string"))
        .when(~F.col("_decoded"), DECODE_ERROR)
        .when(no_document, JSON_ERROR)
        .when(~valid, CONTRACT_ERROR)
        .alias("envelope_class"),
        F.coalesce("payload_errors", none).alias("payload_errors"),
        value_of("event_id").alias("event_id"),
        value_of("event_type").alias("event_type"),
        defaulted("event_version", F.lit(schemas.DEFAULT_EVENT_VERSION).cast("bigint")),
        value_of("occurred_at", "at").alias("occurred_at"),
        defaulted("producer", F.lit(default_producer)),
        value_of("correlation_id").alias("correlation_id"),
        F.col("entity"),
        *map(stored, PAYLOAD_FIELDS),
    ]


def classify(checked: DataFrame, is_known: Column) -> DataFrame:
    """Add `outcome`, `errors`, `error_class` and `reason`.

    Order of decisions: envelope, then the ledger, then the payload. A known event with a
    broken payload is therefore a duplicate, not a reject.
    """
    bad_envelope = F.col("envelope_class").isNotNull()
    outcome = (
        F.when(bad_envelope, REJECTED)
        .when(is_known, DUPLICATE)
        .when(F.size("payload_errors") > 0, REJECTED)
        .otherwise(ACCEPTED)
    )
    rejected = F.col("outcome") == REJECTED
    errors = F.when(bad_envelope, F.col("envelope_errors")).otherwise(F.col("payload_errors"))
    sentence = F.transform("errors", lambda e: F.concat_ws(": ", F.nullif(e["field"], F.lit("")), e["error"]))
    tagged = (
        checked.withColumn("outcome", outcome)
        .withColumns(
            {
                "errors": F.when(rejected, errors),
                "error_class": F.when(rejected, F.coalesce("envelope_class", F.lit(CONTRACT_ERROR))),
            }
        )
        .withColumn("reason", F.array_join(sentence, "; "))
        .drop("envelope_errors", "payload_errors", "envelope_class")
    )
    return settled(tagged)
