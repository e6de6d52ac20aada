"""Log lines rendered from the ``events`` table, and the catalogs that go with them.

The specification below is plain SQL that Spark and other engines read alike. Spark renders each
of its rows as a Docker or CRI line; a reader of the specification knows every field of that line.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podlens import names
from podlens.operators.services import explode_service_domains, usable_services, validate_services
from podlens.options import ServiceOptions
from podlens.session import TASK_ROWS, ensure_parallel, scratch_dir, spread_rows
from podlens.sources.rules import RateRule
from podlens.sources.services import ANNOTATED

SPEC = """
SELECT event_id, ts, event_type, user_id, value AS request_time,
  CASE WHEN event_id % 2 = 0 THEN 'docker' ELSE 'containerd' END AS format,
  CASE WHEN event_id % 53 = 0 THEN 'empty' WHEN event_id % 51 = 0 THEN 'truncated'
       WHEN event_id % 50 = 0 THEN 'plain' ELSE 'json' END AS kind,
  'ns' || CAST(user_id % 4 AS STRING) AS namespace,
  'pod-' || CAST(user_id % 12 AS STRING) AS pod,
  'c' || CAST(user_id % 3 AS STRING) AS container,
  'id' || CAST(user_id % 12 AS STRING) AS id,
  CASE user_id % 5 WHEN 0 THEN 'api.example.com' WHEN 1 THEN 'shop.example.test'
       WHEN 2 THEN 'shop' WHEN 3 THEN 'img.example.test' ELSE 'unknown.host' END AS host,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS request_method,
  '/' || event_type || '/' || CAST(user_id AS STRING)
      || CASE WHEN event_id % 3 = 0 THEN '?ts=online' ELSE '' END AS request_uri,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 ELSE 200 END AS status,
  CASE event_id % 6 WHEN 0 THEN CAST(value AS STRING)
       WHEN 1 THEN CAST(value AS STRING) || ', 0.078'
       WHEN 2 THEN '-' WHEN 3 THEN CAST(value AS STRING) || ', -'
       WHEN 4 THEN '' ELSE NULL END AS upstream_response_time,
  event_id % 10 <> 0 AS sla,
  CASE WHEN event_id % 7 = 0 THEN false WHEN event_id % 7 = 1 THEN true ELSE NULL END AS logging
FROM {events}
"""

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
DEFAULT_DOMAIN = "example.test"
# One task writes about so many config files.
CONFIGS_PER_TASK = 2_000
# A segment file has about so many lines: a stream that takes some files at a time must not get ever more batches.
SEGMENT_ROWS = 200_000
SERVICE_OPTIONS = ServiceOptions(default_domain=DEFAULT_DOMAIN)
PATH_RULES = '[{"online":["ts=online"]},{"buy":["^/purchase"]}]'
RULES = [
    RateRule("ns0", "pod-0", 2.0),
    RateRule("", "pod-1", 5.0),
    RateRule("ns.*", "", 10.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the specification."""
    events = ensure_parallel(table(spark, sf_dir, "events"))
    return spark.sql(SPEC, events=events)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, value, format, path, namespace, pod, container, id, ts)``; also the empty lines."""
    return _rendered(requests(spark, sf_dir))


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as a scan gives them, without the empty ones."""
    return _rendered(requests(spark, sf_dir).where(F.col("kind") != "empty"))


def _rendered(rows: DataFrame) -> DataFrame:
    payload = F.to_json(
        F.struct(
            "host",
            "request_method",
            "request_uri",
            "status",
            "request_time",
            "upstream_response_time",
            "sla",
            "logging",
            F.struct(
                F.col("user_id").alias("id"),
                F.col("event_type").alias("kind"),
                F.array("event_type", "format").alias("tags"),
            ).alias("client"),
        )
    )
    time = F.date_format("ts", TIME_FORMAT)
    docker = F.to_json(
        F.struct(
            F.concat(payload, F.lit("\n")).alias("log"),
            F.lit("stdout").alias("stream"),
            time.alias("time"),
        )
    )
    is_docker = F.col("format") == names.FORMAT_DOCKER
    line = F.when(is_docker, docker).otherwise(F.concat(time, F.lit(" stdout F "), payload))
    value = (
        F.when(F.col("kind") == "empty", F.lit(""))
        .when(F.col("kind") == "truncated", line.substr(F.lit(1), F.length(line) - 4))
        .when(F.col("kind") == "plain", F.concat(F.lit("event "), F.col("event_id").cast("string")))
        .otherwise(line)
    )
    return rows.select(
        "event_id",
        value.alias("value"),
        "format",
        log_path().alias("path"),
        "namespace",
        "pod",
        "container",
        "id",
        "ts",
    )


def log_path():
    folder = F.concat_ws("_", "namespace", "pod", "id")
    docker = F.concat(F.lit("/var/lib/docker/containers/"), "id", F.lit("/"), "id", F.lit("-json.log"))
    cri = F.concat(F.lit("/var/log/pods/"), folder, F.lit("/"), "container", F.lit("/0.log"))
    return F.when(F.col("format") == names.FORMAT_DOCKER, docker).otherwise(cri)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers of the lines."""
    # Events are read as they lie: nothing is rendered here, so they need not be dealt to tasks.
    rows = spark.sql(SPEC, events=table(spark, sf_dir, "events")).select("format", "id", "namespace", "pod", "container")
    return rows.distinct().select(
        F.col("format").alias("type"),
        "id",
        log_path().alias("path"),
        F.lit(True).alias("running"),
        "namespace",
        "pod",
        "container",
    )


def write_segments(spark: SparkSession, sf_dir: str) -> str:
    """The lines as text files below a fresh scratch folder, one folder per container and format."""
    root = scratch_dir(spark, "segments")
    place = ("format", "namespace", "pod", "id", "container")
    rows = spark.sql(SPEC, events=table(spark, sf_dir, "events"))
    longest = rows.groupBy(*place).count().agg(F.max("count")).first()[0] or 0
    # The lines of a folder are dealt to as many tasks as they fill files.
    piece = F.pmod(F.xxhash64("event_id"), F.lit(max(1, -(-longest // SEGMENT_ROWS))))
    dealt = spread_rows(rows, TASK_ROWS, *place, piece)
    rows = _rendered(dealt).select(
        "value", "format", F.concat_ws("_", "namespace", "pod", "id").alias("folder"), "container"
    )
    rows.write.partitionBy("format", "folder", "container").option("lineSep", "\n").text(root)
    return root


def write_configs(rows: DataFrame, root: str, file: str = "config.txt") -> None:
    """Write each ``value`` to the file of its ``folder`` below ``root``, a line for each row, as the runtime does.

    Tasks write their folders themselves: there are as many as containers, too many to be moved one by one
    when a job is committed. A repeated task writes the same files.
    """

    def write(batches):
        files, base = fs.FileSystem.from_uri(root)
        rows = ((folder, value) for b in batches for folder, value in zip(b["folder"].to_pylist(), b["value"].to_pylist()))
        for folder, own in groupby(rows, itemgetter(0)):
            place = f"{base}/folder={folder}"
            files.create_dir(place, recursive=True)
            with files.open_output_stream(f"{place}/{file}") as target:
                target.write("".join(f"{value}\n" for _, value in own).encode())
        yield from ()

    spread = spread_rows(rows.select("folder", "value"), CONFIGS_PER_TASK, "folder")
    spread.sortWithinPartitions("folder").mapInArrow(write, "folder string").collect()


def grow_logs(spark: SparkSession, sf_dir: str, root: str, phase: int, phases: int) -> None:
    """Write the lines of one phase to log files, a folder for each format and pod, as containers do.

    From the second phase on some files grow, some are renamed and begun anew, and some are emptied first.
    """
    lines = log_lines(spark, sf_dir).where(F.col("event_id") % phases == phase)
    file = F.concat_ws(
        "/",
        F.concat(F.lit("format="), "format"),
        F.concat(F.lit("folder="), F.concat_ws("_", "namespace", "pod", "id")),
        F.concat("container", F.lit(".log")),
    )
    rows = lines.select(file.alias("file"), "event_id", "value").repartition("file")

    def write(batches):
        current, target = None, None
        for batch in batches:
            for name, value in zip(batch["file"].to_pylist(), batch["value"].to_pylist()):
                if name != current:
                    if target:
                        target.close()
                    current, path = name, f"{root}/{name}"
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    turn = zlib.crc32(name.encode()) % 3
                    if phase and turn == 1:
                        os.rename(path, f"{path}.{phase}")
                    target = open(path, "wb" if turn == 2 else "ab")
                target.write(value.encode() + b"\n")
        if target:
            target.close()
        yield from ()

    rows.sortWithinPartitions("file", "event_id").mapInArrow(write, "file string").collect()


def buckets(spark: SparkSession, sf_dir: str, days: int) -> range:
    """The numbers of the spans of so many days, counted from the epoch, that the events lie in."""
    number = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (days * 86400))
    row = table(spark, sf_dir, "events").agg(F.min(number), F.max(number)).first()
    return range(row[0] or 0, (row[1] or -1) + 1)


def stream_spans(spark: SparkSession, sf_dir: str, days: int) -> Iterator[DataFrame]:
    """The lines as a stream of tables: one span of days is written after the other, to be taken as one micro-batch.

    Every span has files enough for all cores, and more when these get too many rows. Lines have their
    place and time: ``seq`` and ``arrival``.
    """
    root = scratch_dir(spark, "batches")
    number = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (days * 86400))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    for bucket in buckets(spark, sf_dir, days):
        events = spread_rows(table(spark, sf_dir, "events").where(number == bucket), TASK_ROWS, "event_id")
        rows = _rendered(spark.sql(SPEC, events=events).where(F.col("kind") != "empty")).select(
            "value", "path", F.col("event_id").alias("seq"), (micros / 1e6 / REPLAY_SPEED).alias("arrival"), "ts"
        )
        rows.write.parquet(f"{root}/{bucket}")
        yield spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(root)


# The replay runs this many times faster than the events happened.
REPLAY_SPEED = 10_000

OTHER_PATH_RULES = '[{"online":["ts=online"]},{"buy":["^/signup"]}]'


def hosts_at(spark: SparkSession, version: int) -> DataFrame:
    """The host catalog in a later version: an owner, a path rule and whether a service is there change."""
    owner = "shop" if version % 2 == 0 else "store"
    services = [("api", "api.example.com"), (owner, "shop")]
    services += [("img", "img.example.test")] if version % 4 != 3 else []
    return _hosts(spark, services, PATH_RULES if version % 3 != 1 else OTHER_PATH_RULES)


SERVICES = (
    ("api", "api.example.com"),
    ("shop", "shop"),
    ("img", "img.example.test"),
)


def hosts(spark: SparkSession) -> DataFrame:
    """The host catalog of the three services the lines ask for, stored once per application."""
    return spark.read.parquet(_stored_hosts(spark, spark.sparkContext.applicationId))


@lru_cache(maxsize=1)
def _stored_hosts(spark: SparkSession, application: str) -> str:
    stored = scratch_dir(spark, "hosts")
    _hosts(spark, SERVICES, PATH_RULES).write.parquet(stored)
    return stored


def _hosts(spark: SparkSession, services, rules: str) -> DataFrame:
    annotated = [
        (
            i,
            name,
            {
                SERVICE_OPTIONS.enable: "true",
                SERVICE_OPTIONS.domains: domains,
                SERVICE_OPTIONS.paths: rules,
            },
        )
        for i, (name, domains) in enumerate(services)
    ]
    checked = usable_services(
        validate_services(spark.createDataFrame(annotated, ANNOTATED), SERVICE_OPTIONS), "fail"
    )
    return explode_service_domains(checked, DEFAULT_DOMAIN)
