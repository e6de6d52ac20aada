"""Times the headline jobs and prints one JSON line.

The log lines are rendered from ``events`` and written as segment files first; that is not timed.
Every job then starts from those files, or from the table, as it would on a cluster.
"""

from __future__ import annotations

import json
import os
import sys
import time
from functools import partial

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from podlens.operators.enrich import enrich_with_metadata  # noqa: E402
from podlens.operators.journal import normalise_journal  # noqa: E402
from podlens.operators.metrics import http_request_count, request_samples  # noqa: E402
from podlens.operators.output import to_json_lines  # noqa: E402
from podlens.operators.rates import attach_rate, resolve_rate, throttle_delay  # noqa: E402
from podlens.operators.sli import extract_sli_from_lines, indicators  # noqa: E402
from podlens.options import MetricOptions  # noqa: E402
from podlens.plans import queries, workload  # noqa: E402
from podlens.plans.records import record_lines  # noqa: E402
from podlens.session import configure, scratch_dir  # noqa: E402
from podlens.sources.journal import journal_rows  # noqa: E402
from podlens.sources.lines import scan_log_lines, stream_log_lines  # noqa: E402
from podlens.sources.rules import check_rules  # noqa: E402
from podlens.streaming.jobs import stream_records  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("podlens-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def stream(spark: SparkSession, root: str, catalog: DataFrame) -> None:
    job = stream_records(stream_log_lines(spark, root), lambda: catalog, lambda df, _: drain(df))
    job = job.option("checkpointLocation", scratch_dir(spark, "bench-checkpoint"))
    job.trigger(availableNow=True).start().awaitTermination()


def main() -> None:
    spark = session()
    root = workload.write_segments(spark, SF_DIR)
    stored = scratch_dir(spark, "bench-catalog")
    queries._segment_catalog(spark, root).write.parquet(stored)
    catalog = spark.read.parquet(stored)
    hosts = workload.hosts(spark)
    rules = check_rules(workload.RULES)
    n_lines = scan_log_lines(spark, root).count()

    def lines() -> DataFrame:
        line_format = F.regexp_extract("path", "format=([^/]*)", 1)
        return scan_log_lines(spark, root).withColumn("format", line_format)

    def requests() -> DataFrame:
        return indicators(extract_sli_from_lines(lines()), hosts)

    def replay() -> DataFrame:
        seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / workload.REPLAY_SPEED
        narrow = workload.requests(spark, SF_DIR).select(
            workload.log_path().alias("path"), "namespace", "pod", F.col("event_id").alias("seq"), seconds.alias("arrival")
        )
        # Narrow slices, so that a file has many, as it would at scale.
        return throttle_delay(attach_rate(narrow, catalog, rules), slice_width=1000)

    jobs = {
        "scan": lambda: drain(lines()),
        "request_count": lambda: drain(http_request_count(requests())),
        "request_samples": lambda: drain(request_samples(requests(), MetricOptions(sum_scale=3))),
        "records_json": lambda: drain(record_lines(enrich_with_metadata(lines(), catalog))),
        "journal_json": lambda: drain(
            to_json_lines(normalise_journal(journal_rows(queries._journal_text(spark, SF_DIR))))
        ),
        "resolve_rates": lambda: drain(resolve_rate(catalog, rules)),
        "throttle_replay": lambda: drain(replay()),
        "stream_records": partial(stream, spark, root, catalog),
    }
    seconds: dict[str, float] = {}
    for name, job in jobs.items():
        taken = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            job()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(min(taken), 3)
    rates = {name: round(n_lines / taken) for name, taken in seconds.items() if name != "resolve_rates"}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "lines": n_lines,
                "lines_per_second": rates,
                "cpus": int(CPUS),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
