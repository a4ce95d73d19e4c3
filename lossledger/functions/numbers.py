"""Money and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
MONEY_TOTAL = "decimal(38,2)"


def money(col: Column | str) -> Column:
    """Double to cents.

    Scaled and rounded as a double first: a direct cast rounds the shortest decimal text of
    the double instead and moves values such as 1.005 by a cent.
    """
    value = F.col(col) if isinstance(col, str) else col
    return (F.round(value * 100) / 100).cast(MONEY)


def round_half_up(col: Column, digits: int) -> Column:
    """Round a double on its binary value; `round(x, digits)` works on its decimal text."""
    scale = 10**digits
    return F.round(col * scale) / scale


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when there is no whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))
