"""Upstream response times: a number, or text such as ``"0.020, 0.078"``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from podlens.functions.numbers import finite, float_text
from podlens.functions.variants import is_number, text_of


def _parts(text: Column) -> Column:
    return F.split(F.replace(text, F.lit(" "), F.lit("")), ",")


def _passed_through(value: Column, from_text: Column) -> Column:
    return F.when(is_number(value), value).otherwise(from_text.cast("variant"))


def last_time_text(text: Column) -> Column:
    """The last comma-separated time, NULL when it is no number."""
    return float_text(F.element_at(_parts(text), -1))


def total_time_text(text: Column) -> Column:
    """The sum of the parts that are numbers, to 3 places; NULL when there is none."""
    none = F.lit(None).cast("double")
    total = F.aggregate(
        F.transform(_parts(text), lambda part: float_text(part)),
        none,
        lambda total, time: F.coalesce(total + time, total, time),
    )
    single = float_text(F.replace(text, F.lit(" "), F.lit("")))
    return finite(F.round(F.when(F.contains(text, F.lit(",")), total).otherwise(single) * 1000) / 1000)


def upstream_time_last(value: Column) -> Column:
    """VARIANT with the last upstream time; NULL when ``value`` holds none."""
    return _passed_through(value, last_time_text(text_of(value)))


def upstream_time_total(value: Column) -> Column:
    """VARIANT with the total upstream time; NULL when ``value`` holds none."""
    return _passed_through(value, total_time_text(text_of(value)))
