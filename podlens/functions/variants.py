"""Type tests and conversions for VARIANT values.

A cast of a VARIANT converts between types (the string "false" becomes a boolean), so every
typed read below checks the stored type first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "map<string,variant>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, which may refer to it several times."""
    return F.transform(F.array(value), use)[0]


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_boolean(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "BOOLEAN", F.lit(False))


def is_number(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))


def text_of(value: Column) -> Column:
    """The string inside ``value``, NULL for every other type."""
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def number_of(value: Column) -> Column:
    """The number inside ``value`` as DOUBLE, NULL for every other type."""
    # A whole number is read as it is stored; the conversion of other types costs more.
    whole = F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return F.when(whole.isNotNull(), whole.cast("double")).when(
        is_number(value), F.try_variant_get(value, "$", "double")
    )


def flag_of(value: Column) -> Column:
    """The boolean inside ``value``, NULL for every other type."""
    return F.when(is_boolean(value), F.try_variant_get(value, "$", "boolean"))


def fields_of(value: Column) -> Column:
    """The fields of an object, NULL for every other type."""
    return value.try_cast(FIELDS)


def no_fields() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
