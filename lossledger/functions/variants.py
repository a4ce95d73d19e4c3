"""Lenient typing of JSON values.

`cell` reads the JSON type and the text of a VARIANT. Each typing function takes that pair
and gives a typed column that is null when the value does not fit. Accepted spellings follow common lax validation:
numbers may be text with spaces or digit separators, whole numbers may have a zero fraction,
days may be midnight datetimes, and days and instants may be Unix seconds or milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Unicode white space, as a Java regex class body.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_DECIMAL_TEXT = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
_SPECIAL_TEXT = r"^[+-]?(?i:inf|infinity|nan)\z"
_WHOLE_TEXT = rf"^[+-]?{_DIGITS}(?:\.0+)?\z"
_EPOCH_TEXT = r"^[+-]?[0-9]+(?:\.[0-9]+)?\z"
_DAY_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
# Groups: day, hour and minute, second, fraction, offset. Either kind of minus sign is read.
_INSTANT_TEXT = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2})"
    r"(?:[Tt _]([0-9]{2}:[0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?"
    r"([Zz]|[+\-\u2212](?:[01][0-9]|2[0-3]):?[0-5][0-9])?)?\z"
)

# Fixed value: larger epoch numbers are milliseconds.
_MILLIS_FROM = 2e10
_FIRST_INSTANT, _LAST_INSTANT = -62_135_596_800.0, 253_402_300_800.0  # years 1 to 9999
_DAY_MICROS = 86_400_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def cell(v: Column) -> Column:
    """struct<type, text>: JSON type and text of a value."""
    return F.struct(
        F.schema_of_variant(v).alias("type"), F.try_variant_get(v, "$", "string").alias("text")
    )


def _is_numeric(t: Column) -> Column:
    return t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{_SPACE}]+|[{_SPACE}]+\\z", "")


def _plain(s: Column) -> Column:
    return F.replace(s, F.lit("_"), F.lit(""))


def members(v: Column) -> Column:
    """An object's members by key; null for anything that is not an object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def text(t: Column, s: Column) -> Column:
    return F.when(t == "STRING", s)


def number(t: Column, s: Column) -> Column:
    def spelled(s: Column) -> Column:
        return F.when(s.rlike(_DECIMAL_TEXT) | s.rlike(_SPECIAL_TEXT), _plain(s).try_cast("double"))

    return (
        F.when(_is_numeric(t), s.try_cast("double"))
        .when(t == "STRING", let(_trim(s), spelled))
        .when(t == "BOOLEAN", F.when(s == "true", 1.0).otherwise(0.0))
    )


def whole(t: Column, s: Column) -> Column:
    def spelled(s: Column) -> Column:
        units = F.split_part(_plain(s), F.lit("."), F.lit(1))
        return F.when(s.rlike(_WHOLE_TEXT), units.try_cast("bigint"))

    def integral(x: Column) -> Column:
        return F.when(x == F.floor(x), x.try_cast("bigint"))

    return (
        F.when(t == "BIGINT", s.try_cast("bigint"))
        .when(_is_numeric(t), let(s.try_cast("double"), integral))
        .when(t == "STRING", let(_trim(s), spelled))
        .when(t == "BOOLEAN", F.when(s == "true", 1).otherwise(0).cast("bigint"))
    )


def _epoch(x: Column) -> Column:
    seconds = F.when(F.abs(x) > _MILLIS_FROM, x / 1000).otherwise(x)
    return let(
        seconds,
        lambda n: F.when(
            (n >= _FIRST_INSTANT) & (n < _LAST_INSTANT),
            F.timestamp_micros(F.round(n * 1e6).cast("bigint")),
        ),
    )


def _epoch_number(t: Column, s: Column) -> Column:
    """The double behind a number or a numeric text."""
    return F.when(_is_numeric(t) | ((t == "STRING") & s.rlike(_EPOCH_TEXT)), s.try_cast("double"))


def _parts(s: Column) -> Column:
    """[day, hour:minute, second, fraction, offset] of a datetime text."""
    return F.split(F.regexp_replace(s, _INSTANT_TEXT, "$1|$2|$3|$4|$5"), r"\|")


def _or(s: Column, default: str) -> Column:
    return F.when(s == "", default).otherwise(s)


def _wall_text(p: Column) -> Column:
    """yyyy-MM-ddThh:mm:ss.ffffff without an offset; digits beyond microseconds are cut."""
    fraction = F.rpad(F.left(p[3], F.lit(6)), 6, "0")
    return F.concat(
        p[0], F.lit("T"), _or(p[1], "00:00"), F.lit(":"), _or(p[2], "00"), F.lit("."), fraction
    )


def _wall(s: Column) -> Column:
    """struct<text, at, offset> of a datetime text: wall-clock time, read as if it were UTC.

    Null for text of another form and for times that do not exist.
    """

    def read(p: Column) -> Column:
        return F.struct(_wall_text(p).alias("text"), p[4].alias("offset"))

    def exists(w: Column) -> Column:
        at = F.concat(w["text"], F.lit("Z")).try_cast("timestamp")
        return F.struct(
            w["text"].alias("text"),
            F.when(~w["text"].startswith("0000"), at).alias("at"),
            w["offset"].alias("offset"),
        )

    found = F.when(s.rlike(_INSTANT_TEXT), let(let(_parts(s), read), exists))
    return let(found, lambda w: F.when(w["at"].isNotNull(), w))


def _offset_minutes(o: Column) -> Column:
    minutes = F.substring(o, 2, 2).cast("int") * 60 + F.right(o, F.lit(2)).cast("int")
    return (
        F.when(o.isin("", "Z", "z"), 0).when(o.startswith("+"), minutes).otherwise(-minutes)
    )


def _offset_text(o: Column) -> Column:
    sign = F.when(o.startswith("+"), "+").otherwise("-")
    spelled = F.concat(sign, F.substring(o, 2, 2), F.lit(":"), F.right(o, F.lit(2)))
    zero = o.isin("Z", "z") | ((F.substring(o, 2, 2) == "00") & F.right(o, F.lit(2)).eqNullSafe("00"))
    return F.when(o == "", "").when(zero, "+00:00").otherwise(spelled)


def _without_zero_fraction(s: Column) -> Column:
    return F.when(s.endswith(".000000"), F.left(s, F.lit(19))).otherwise(s)


def instant(t: Column, s: Column) -> Column:
    """struct<at, aware, iso>: the UTC instant, whether it named an offset, and its ISO text."""

    def from_wall(w: Column) -> Column:
        shift = _offset_minutes(w["offset"]).cast("bigint") * 60_000_000
        return F.when(
            w.isNotNull(),
            F.struct(
                F.timestamp_micros(F.unix_micros(w["at"]) - shift).alias("at"),
                (w["offset"] != "").alias("aware"),
                F.concat(_without_zero_fraction(w["text"]), _offset_text(w["offset"])).alias("iso"),
            ),
        )

    def from_epoch(at: Column) -> Column:
        text_of = _without_zero_fraction(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        return F.when(
            at.isNotNull(),
            F.struct(
                at.alias("at"),
                F.lit(True).alias("aware"),
                F.concat(text_of, F.lit("+00:00")).alias("iso"),
            ),
        )

    return F.coalesce(
        let(F.when(t == "STRING", _wall(s)), from_wall),
        let(_epoch(_epoch_number(t, s)), from_epoch),
    )


def day(t: Column, s: Column) -> Column:
    """ISO text of a day, or of the day a midnight datetime falls on."""

    def midnight(at: Column) -> Column:
        return F.when(
            F.pmod(F.unix_micros(at), F.lit(_DAY_MICROS)) == 0, F.date_format(at, "yyyy-MM-dd")
        )

    real = s.rlike(_DAY_TEXT) & ~s.startswith("0000") & s.try_cast("date").isNotNull()
    other = F.coalesce(F.when(t == "STRING", _wall(s))["at"], _epoch(_epoch_number(t, s)))
    return F.coalesce(F.when((t == "STRING") & real, s), let(other, midnight))
