"""Session settings, the shared scratch folder and the size check for broadcast sides."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from functools import lru_cache

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import podlens

# A later map entry replaces an earlier one, and so does a repeated JSON key.
REQUIRED_CONF = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Live metrics may have many label sets, so their state lives outside the heap.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

# Sides of at most this size are broadcast; larger ones use a shuffle join. The size is measured as JSON.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 256 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Set the two settings that record building relies on."""
    return _set(spark, REQUIRED_CONF)


def configure_state(spark: SparkSession) -> SparkSession:
    """Keep the state of streaming metrics in RocksDB; to be set before a query starts."""
    return _set(spark, STATE_CONF)


def _set(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    for key, value in conf.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder of the cluster.

    Where none is configured, a local one is made and set if the session runs on this machine alone;
    on a cluster that is an error, as other machines would not see its files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("podlens.scratch.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[[^-]*\])?$", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = tempfile.mkdtemp(prefix="podlens-")
        spark.conf.set("podlens.scratch.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for jobs started without it on their Python path."""
    _ship(spark, spark.sparkContext.applicationId)


@lru_cache(maxsize=1)
def _ship(spark: SparkSession, application: str) -> None:
    folder = scratch_dir(spark, "package").removeprefix("file:")
    if "://" in folder:
        # The archive is only read by the driver, which hands it to the executors.
        folder = tempfile.mkdtemp(prefix="podlens-")
    package = os.path.dirname(os.path.abspath(__file__))
    os.makedirs(folder, exist_ok=True)
    archive = f"{folder}/podlens.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for parent, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(parent, name)
                    target.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)


def pickle_by_value() -> None:
    """Let data sources travel with their code: Spark plans them in processes of their own."""
    cloudpickle.register_pickle_by_value(podlens)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most that many rows and bytes; reads no more than one row beyond that."""
    # Binary columns are counted as they are; JSON would hold them as text.
    raw = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in df.dtypes if kind == "binary"]
    rest = [name for name, kind in df.dtypes if kind != "binary"]
    size = sum(raw, F.octet_length(F.to_json(F.struct(*rest))) if rest else F.lit(0))
    row = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return row[0] <= max_rows and row[1] <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when its measured size allows; otherwise leave it to a shuffle join.

    The shuffle join keeps adaptive skew handling, so one hot key is split over several tasks.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


# About so many rows of a table are rendered, parsed or written by one task.
TASK_ROWS = 50_000


def spread_rows(df: DataFrame, task_rows: int, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` to as many tasks as the cluster has cores, and to more when these get too many rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // task_rows)), *keys)


def ensure_parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows when fewer splits than the cluster has cores hold them, or when a split holds too many.

    A one-row-group file otherwise runs as one task, and the tasks of a large file grow with it. Spark may also
    cut such a file into many splits, of which one gets all rows. So the rows of each split are counted,
    which costs no more than the footers where ``df`` is a table. Inputs with enough filled splits, none too
    large, are left as they are. Without ``keys`` rows are dealt in turn; with them, a value (or NULL) that
    many rows have brings all these into one task.
    """
    splits = df.groupBy(F.spark_partition_id()).count()
    rows, filled, fullest = splits.agg(F.sum("count"), F.count("*"), F.max("count")).first()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-(rows or 0) // TASK_ROWS))
    return df if filled >= parts and fullest <= TASK_ROWS else df.repartition(parts, *keys)
