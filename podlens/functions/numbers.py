"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted number syntax. The cast alone also takes blanks and type suffixes.
DECIMAL_SYNTAX = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL_SYNTAX = r"(?i)^([+-]?inf(inity)?|nan)$"
INTEGER_SYNTAX = r"^[+-]?[0-9]+$"


def finite(value: Column) -> Column:
    """The value, NULL for infinities and NaN: zero times these is NaN."""
    return F.nanvl(value + value * 0, F.lit(None).cast("double"))


def float_text(text: Column, specials: bool = False) -> Column:
    """DOUBLE from strict number text, NULL otherwise; ``specials`` also takes infinities and NaN."""
    number = F.when(text.rlike(DECIMAL_SYNTAX), finite(text.try_cast("double")))
    if specials:
        number = F.coalesce(number, F.when(text.rlike(SPECIAL_SYNTAX), text.try_cast("double")))
    return number


def integer_text(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_SYNTAX), text.try_cast("bigint"))
