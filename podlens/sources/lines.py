"""Log lines from files, in batch and as a stream of closed segments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podlens.sources.containers import cri_columns, row_path


def _lines(raw: DataFrame, *columns: str) -> DataFrame:
    """Cut one carriage return off the end of each line and leave out the empty lines."""
    value = F.col("value")
    cut = F.when(F.endswith(value, F.lit("\r")), F.substring(value, F.lit(1), F.length(value) - 1))
    return raw.select(F.coalesce(cut, value).alias("value"), row_path().alias("path"), *columns).where(F.length("value") > 0)


def scan_log_lines(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """``(value, path)`` for every line. Only ``\\n`` ends a line; the last one may go without.

    Large files are split by ``spark.sql.files.maxPartitionBytes``, so one hot file is read by
    many tasks.
    """
    return _lines(spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(glob))


def scan_partitioned_lines(spark: SparkSession, root: str, columns: list[str], stream: bool = False) -> DataFrame:
    """The same for folders named ``column=value``, with these columns, in batch or as a stream.

    Filters on the columns choose folders before any file in them is listed or opened.
    """
    schema = ", ".join(["value string", *(f"`{name}` string" for name in columns)])
    reader = (spark.readStream if stream else spark.read).schema(schema).option("lineSep", "\n")
    return _lines(reader.text(root), *columns)


def _glob_text(text: str | None) -> str:
    """A name for a glob, with its special signs escaped; any name for None."""
    return "*" if text is None else re.sub(r"([\\*?\[\]{},^])", r"\\\1", text)


def pod_log_glob(
    root: str, namespace: str | None = None, pod: str | None = None, container: str | None = None
) -> str:
    """The logs below a root of pod folders (``namespace_pod_id/container/*.log``) of the given names only.

    What is not asked for is not listed, so a scan of one namespace costs what that namespace has.
    """
    folder = f"{_glob_text(namespace)}_{_glob_text(pod)}_*"
    return f"{root.rstrip('/')}/{folder}/{_glob_text(container)}/*.log"


def scan_pod_lines(
    spark: SparkSession,
    root: str,
    namespace: str | None = None,
    pod: str | None = None,
    container: str | None = None,
) -> DataFrame:
    """Lines of pod logs with ``namespace``, ``pod``, ``container`` and ``id`` out of their paths.

    Names of a namespace or pod do not hold underscores, so the template finds each in its place.
    """
    raw = spark.read.option("lineSep", "\n").text(pod_log_glob(root, namespace, pod, container))
    return _lines(raw).select("*", *cri_columns("path"))


def stream_log_lines(
    spark: SparkSession, glob: str, max_files: int | None = 1000, modified_after: str | None = None
) -> DataFrame:
    """The same as a stream over closed segments; the checkpoint of the query holds the position.

    A file is read once, when it first appears. Files that still grow need the tail source.
    """
    reader = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return _lines(reader.text(glob))


def chunks(line: Column, max_bytes: int) -> Column:
    """The bytes of a line in pieces of at most ``max_bytes``."""
    data = F.encode(line, "UTF-8")
    last = F.floor((F.octet_length(line) - 1) / max_bytes).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    return F.transform(starts, lambda i: F.substring(data, i * max_bytes + 1, F.lit(max_bytes)))


def split_oversize_lines(lines: DataFrame, max_bytes: int = 32000) -> DataFrame:
    """A line longer than the buffer becomes several consecutive lines, numbered by ``chunk``.

    A cut may fall inside a character; the broken ends become replacement characters.
    """
    others = [c for c in lines.columns if c != "value"]
    fits = F.octet_length("value") <= max_bytes
    whole = F.array(F.encode("value", "UTF-8"))
    pieces = F.when(fits, whole).otherwise(chunks(F.col("value"), max_bytes))
    split = lines.select(*others, F.posexplode(pieces).alias("chunk", "_bytes"))
    return split.withColumn("value", F.make_valid_utf8(F.col("_bytes").cast("string"))).drop("_bytes")


def bounded_lines(lines: DataFrame, max_bytes: int) -> DataFrame:
    """The same lines, with those beyond ``max_bytes`` in pieces, as the pipelines read them."""
    others = [c for c in lines.columns if c != "value"]
    pieces = F.transform(chunks(F.col("value"), max_bytes), lambda piece: F.make_valid_utf8(piece.cast("string")))
    fits = F.coalesce(F.octet_length("value") <= max_bytes, F.lit(True))
    return lines.select(*others, F.explode(F.when(fits, F.array("value")).otherwise(pieces)).alias("value"))
