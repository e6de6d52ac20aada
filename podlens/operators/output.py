"""Records as JSON text, and the union of the container and journal outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_text(record: Column) -> Column:
    """One JSON object with sorted keys."""
    return F.to_json(F.to_variant_object(record))


def to_json_lines(records: DataFrame) -> DataFrame:
    """One ``value`` per record; a record that cannot be written as JSON is skipped."""
    return records.select(F.explode(F.array_compact(F.array(json_text(F.col("record"))))).alias("value"))


def union_outputs(containers: DataFrame, journal: DataFrame) -> DataFrame:
    """Journal JSON joins container JSON after parsing, indicators and filters."""
    return containers.select("value").unionByName(journal.select("value"))
