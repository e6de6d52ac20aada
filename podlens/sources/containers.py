"""Container catalogs and their differences to a ledger of known positions.

A catalog row is ``(type, id, path, running, namespace, pod, container, labels)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podlens import names

LOG_SUFFIX = ".log"
CONFIG_SCHEMA = (
    "ID string, State struct<Running: boolean>, Config struct<Labels: map<string,string>>, LogPath string"
)


def local_path(uri: Column) -> Column:
    """A file name without the scheme that Spark puts before it."""
    return (
        F.when(F.startswith(uri, F.lit("file:///")), F.substring(uri, 8, 1 << 30))
        .when(F.startswith(uri, F.lit("file:/")), F.substring(uri, 6, 1 << 30))
        .otherwise(uri)
    )


def row_path() -> Column:
    """The path of the file that a row was read from. Spark gives it as a URI, with signs escaped."""
    uri = F.col("_metadata.file_path")
    plain = F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return local_path(F.when(F.contains(uri, F.lit("%")), F.coalesce(plain, uri)).otherwise(uri))


def _label(name: str) -> Column:
    return F.coalesce(F.col("labels")[name], F.lit(""))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def container_catalog_docker(
    spark: SparkSession, config_glob: str, logs: DataFrame | None = None
) -> DataFrame:
    """Containers from their config files, which lie beside the logs.

    ``logs`` lists the log paths; without it each container has the one log ``<id>-json.log``.
    """
    configs = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(config_glob)
    file = row_path()
    found = configs.select("*", _folder(file).alias("_folder")).where(F.col("ID").isNotNull())
    if logs is None:
        found = found.withColumn("path", F.concat("_folder", F.lit("/"), "ID", F.lit("-json.log")))
    else:
        found = logs.select("path", _folder(F.col("path")).alias("_folder")).join(found, "_folder")
    return (
        found.select(
            F.lit(names.FORMAT_DOCKER).alias("type"),
            F.col("ID").alias("id"),
            "path",
            F.coalesce(F.col("State.Running"), F.lit(False)).alias("running"),
            F.coalesce(F.col("Config.Labels"), F.create_map().cast("map<string,string>")).alias("labels"),
        )
        .select(
            "type",
            "id",
            "path",
            "running",
            _label(names.LABEL_NAMESPACE).alias("namespace"),
            _label(names.LABEL_POD).alias("pod"),
            _label(names.LABEL_CONTAINER).alias("container"),
            "labels",
        )
    )


def _path_part(path: str, back: int) -> Column:
    return F.try_element_at(F.split(F.col(path), "/"), F.lit(-back))


def cri_columns(path: str) -> list[Column]:
    """Columns ``id``, ``namespace``, ``pod`` and ``container`` out of a CRI log path.

    The folder above the container folder is ``namespace_pod_id``.
    """
    parts = F.split(_path_part(path, 3), "_")
    known = F.size(parts) >= 3
    return [
        F.when(known, F.get(parts, F.lit(2))).alias("id"),
        F.when(known, F.get(parts, F.lit(0))).alias("namespace"),
        F.when(known, F.get(parts, F.lit(1))).alias("pod"),
        F.when(known, _path_part(path, 2)).alias("container"),
    ]


def container_catalog_cri(paths: DataFrame) -> DataFrame:
    """Containers from log paths alone; they always count as running.

    A path whose folder does not name namespace, pod and id is left to :func:`cri_quarantine`.
    """
    labels = F.create_map(
        F.lit(names.LABEL_POD),
        F.col("pod"),
        F.lit(names.LABEL_NAMESPACE),
        F.col("namespace"),
        F.lit(names.LABEL_CONTAINER),
        F.col("container"),
    )
    return (
        paths.select("path", *cri_columns("path"))
        .where(F.col("id").isNotNull())
        .select(
            F.lit(names.FORMAT_CRI).alias("type"),
            "id",
            "path",
            F.lit(True).alias("running"),
            "namespace",
            "pod",
            "container",
            labels.alias("labels"),
        )
    )


def cri_quarantine(paths: DataFrame) -> DataFrame:
    """Paths that name no container, with the reason."""
    return (
        paths.select("path", *cri_columns("path"))
        .where(F.col("id").isNull())
        .select("path", F.lit("folder is not namespace_pod_id").alias("reason"))
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below ``root``, at any depth. Lists names; reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(local_path(F.col("path")).alias("path"))


def filter_catalog(catalog: DataFrame, root: str, exclude: str | None = None) -> DataFrame:
    """Log files below the root (not in it), without the containers named like ``exclude``.

    The suffix is only asked of CRI paths.
    """
    base = root.rstrip("/") + "/"
    inner = F.substring(F.col("path"), len(base) + 1, 1 << 30)
    below = F.startswith(F.col("path"), F.lit(base)) & F.contains(inner, F.lit("/"))
    suffix = (F.col("type") != names.FORMAT_CRI) | F.endswith(F.col("path"), F.lit(LOG_SUFFIX))
    kept = catalog.where(below & suffix)
    return kept.where(~F.contains(F.col("container"), F.lit(exclude))) if exclude else kept


def orphan_positions(ledger: DataFrame, catalog: DataFrame) -> DataFrame:
    """Known positions without a container, to be deleted; the journal position is never one."""
    known = ledger.where(F.col("path") != names.JOURNAL_LEDGER_KEY)
    return known.join(catalog.select("path"), "path", "left_anti")


def new_sources(catalog: DataFrame, followed: DataFrame, ignored: DataFrame) -> DataFrame:
    """Containers that are neither followed nor ignored yet."""
    unknown = catalog.join(followed.select("path"), "path", "left_anti")
    return unknown.join(ignored.select("path"), "path", "left_anti")


def finished_sources(catalog: DataFrame, followed: DataFrame) -> DataFrame:
    """Followed containers that no longer run: read to the end, then ignored."""
    return catalog.where(~F.col("running")).join(followed.select("path"), "path", "left_semi")


def stale_ignores(ignored: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ignored paths whose container is gone."""
    return ignored.join(catalog.select("path"), "path", "left_anti")


def source_inventory_diff(
    ledger: DataFrame, catalog: DataFrame, followed: DataFrame, ignored: DataFrame
) -> DataFrame:
    """All four differences as ``(path, change)`` rows."""
    parts = {
        "orphan": orphan_positions(ledger, catalog),
        "new": new_sources(catalog, followed, ignored),
        "finished": finished_sources(catalog, followed),
        "unignored": stale_ignores(ignored, catalog),
    }
    changes = [df.select("path", F.lit(change).alias("change")) for change, df in parts.items()]
    result = changes[0]
    for df in changes[1:]:
        result = result.unionByName(df)
    return result
