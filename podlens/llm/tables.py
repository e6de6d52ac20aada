"""Reading the documents, cutting lineage, and numbering rows without one task that sees them all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podlens.session import scratch_dir

# Arrow batches are cut by bytes, so that a run of very long texts does not fill a worker.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
}


# Folders that a stage made, and their names in the catalog if they have any, from the stage's begin on.
_made: list[tuple[str, str | None]] = []
_noting = [False]


def _note(folder: str, name: str | None = None) -> None:
    if _noting[0]:
        _made.append((folder, name))


@contextmanager
def stage_tables(docs: DataFrame) -> Iterator[None]:
    """Note the tables that a stage makes, and drop those of stages before it.

    A stage reads what the one before wrote, so the tables behind that are not needed any more. Tables
    that ``docs`` itself is read from stay, as they do when a stage gets an unwritten result.
    """
    spark, files = docs.sparkSession, docs.inputFiles() if _made else []
    for folder, name in list(_made):
        plain = folder.split(":", 1)[-1].lstrip("/")
        if any(plain in file for file in files):
            continue
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove((folder, name))
    _noting[0] = True
    try:
        yield
    finally:
        _noting[0] = False


def prepare(spark: SparkSession) -> SparkSession:
    """Set the batch size of Arrow transfers."""
    for key, value in BATCH_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def store(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: later steps do not repeat it.

    Tables with whole texts or ids are worth ``zstd``, which takes memory outside the heap.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    _note(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def pieces(total: int, each: int, least: int = 1) -> int:
    """How many pieces of about ``each`` the ``total`` gives; it grows with the input, without a cap."""
    return max(least, -(-total // each))


def scattered(key: str | Column, n: int, seed: int = 0) -> Column:
    """A number from 0 to ``n`` - 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n)).cast("int")


def blocked(docs: DataFrame, columns: list[str | Column], key: Column, n: int) -> DataFrame:
    """Store the documents once, dealt into ``n`` blocks, so that several passes by block need no shuffle.

    The table lies in the shared scratch folder; its entry in the session's catalog only tells Spark
    how the files are dealt.
    """
    spark = docs.sparkSession
    name = f"podlens_blocks_{uuid.uuid4().hex}"
    rows = docs.select(*columns, key.alias("block")).repartition(n, "block")
    path = scratch_dir(spark, "blocks")
    _note(path, name)
    writer = rows.write.option("compression", "zstd").option("path", path)
    writer.bucketBy(n, "block").format("parquet").saveAsTable(name)
    return spark.table(name)
