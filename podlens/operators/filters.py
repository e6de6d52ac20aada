"""Suppressed records and the reserved keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podlens import names
from podlens.functions.maps import drop_keys, extend_map, group
from podlens.functions.variants import bind, fields_of, flag_of

RESERVED = (names.KEY_LOGGING, names.KEY_SLA)


def deliverable(record: Column, user_key: str = "") -> Column:
    """False where the record says ``logging: false``, as a boolean."""
    if user_key:
        flag = F.try_variant_get(record[user_key], f"$.{names.KEY_LOGGING}", "variant")
    else:
        flag = record[names.KEY_LOGGING]
    return F.coalesce(flag_of(flag), F.lit(True))


def without_reserved(record: Column, user_key: str = "") -> Column:
    """The record without the control keys, whatever their type."""
    if not user_key:
        return drop_keys(record, RESERVED)
    return bind(
        fields_of(record[user_key]),
        lambda fields: F.when(
            fields.isNotNull(), extend_map(record, group(user_key, drop_keys(fields, RESERVED)))
        ).otherwise(record),
    )


def drop_suppressed(records: DataFrame, user_key: str = "") -> DataFrame:
    """Keep the records that may be delivered."""
    return records.where(deliverable(F.col("record"), user_key))


def strip_reserved(records: DataFrame, user_key: str = "") -> DataFrame:
    """Remove the control keys."""
    return records.withColumn("record", without_reserved(F.col("record"), user_key))
