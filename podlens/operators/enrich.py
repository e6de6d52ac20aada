"""Metadata for every line: the static fields of a node, overlaid by those of the container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podlens import names
from podlens.functions.maps import extend_map, literal_fields
from podlens.options import StaticMetadata
from podlens.session import small_side


def container_fields(container_id: Column, pod: Column, namespace: Column, container: Column) -> Column:
    pairs = (
        (names.META_CONTAINER_ID, container_id),
        (names.META_POD, pod),
        (names.META_NAMESPACE, namespace),
        (names.META_CONTAINER, container),
    )
    parts: list[Column] = []
    for key, value in pairs:
        parts += [F.lit(key), value.cast("variant")]
    return F.create_map(*parts)


def with_ext(lines: DataFrame, static: StaticMetadata = StaticMetadata()) -> DataFrame:
    """Column ``ext`` from the container columns of each line; only static fields where they are NULL."""
    fixed = literal_fields(static.fields())
    own = container_fields(F.col("id"), F.col("pod"), F.col("namespace"), F.col("container"))
    return lines.withColumn("ext", F.when(F.col("id").isNotNull(), extend_map(fixed, own)).otherwise(fixed))


def enrich_with_metadata(
    lines: DataFrame, catalog: DataFrame, static: StaticMetadata = StaticMetadata()
) -> DataFrame:
    """Attach ``format``, the container columns and ``ext`` to every line by its path.

    A catalog of measured small size is broadcast. A larger one is joined by shuffle, where
    adaptive execution splits the lines of a hot container over several tasks.
    """
    containers = catalog.select("path", F.col("type").alias("format"), "id", "namespace", "pod", "container")
    kept = [c for c in lines.columns if c not in containers.columns or c == "path"]
    return with_ext(lines.select(*kept).join(small_side(containers), "path", "left"), static)


def enrich_cri_by_path(lines: DataFrame, static: StaticMetadata = StaticMetadata()) -> DataFrame:
    """The same for CRI lines without any join: the path itself names the container."""
    from podlens.sources.containers import cri_columns

    return with_ext(lines.select("*", F.lit(names.FORMAT_CRI).alias("format"), *cri_columns("path")), static)
