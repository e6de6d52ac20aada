"""Service annotations: from a config file or from an exported service list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podlens.sources.config import read_list

ANNOTATED = "ord long, name string, annotations map<string,string>"
EXPORT = (
    "items array<struct<metadata: struct<name: string, namespace: string, annotations: map<string,string>>>>"
)


def load_service_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, name, annotations)`` from a list of annotation maps; the ``name`` entry is optional."""
    entries = read_list(spark, path)
    rows = [(i, entry.get("name") or "", entry) for i, entry in enumerate(entries)]
    return spark.createDataFrame(rows, ANNOTATED)


def load_exported_services(spark: SparkSession, path: str, single_document: bool = True) -> DataFrame:
    """The same from an exported list of cluster services; the name is that of the object.

    A file is one JSON document, or holds one list per line with ``single_document=False``. ``ord``
    counts through all files by name, all their lists and all items.
    """
    exported = spark.read.schema(EXPORT).option("multiLine", single_document).json(path)
    place = [F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")]
    lists = exported.select("items", *place)
    items = lists.select("file", "line", F.posexplode("items").alias("at", "item"))
    # The catalog is configuration, small enough to be numbered in one place.
    number = F.row_number().over(Window.orderBy("file", "line", "at")) - 1
    return items.select(
        number.cast("long").alias("ord"),
        F.col("item.metadata.name").alias("name"),
        F.coalesce("item.metadata.annotations", F.create_map().cast("map<string,string>")).alias("annotations"),
    )
