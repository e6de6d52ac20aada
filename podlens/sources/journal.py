"""Exported journal rows, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podlens import names
from podlens.functions.documents import document, document_fields
from podlens.functions.maps import drop_keys, extend_map
from podlens.operators.rows import settle

# The field that holds the time of a row in the usual export, in microseconds as text.
EXPORT_TIME = "__REALTIME_TIMESTAMP"


def journal_rows(text: DataFrame) -> DataFrame:
    """``value`` text to ``row`` maps; lines that are no object are left out.

    The export time becomes ``time``, as the journal reader names it.
    """
    value = F.col("value")
    parsed = settle(text, {"_doc": document(value)})
    rows = parsed.select("*", document_fields(F.col("_doc"), value).alias("row")).where(F.col("row").isNotNull())
    moved = extend_map(
        drop_keys(F.col("row"), [EXPORT_TIME]),
        F.create_map(F.lit(names.KEY_TIME), F.col("row")[EXPORT_TIME]),
    )
    stamped = F.when(F.map_contains_key("row", EXPORT_TIME), moved).otherwise(F.col("row"))
    return rows.withColumn("row", stamped).drop("value", "_doc")


def scan_journal_export(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    return journal_rows(spark.read.option("lineSep", "\n").text(glob))
