"""All metrics of a running stream, from one pass over every micro-batch.

Counters, histograms and delays are sums, so a batch is aggregated on its own and added to the totals
before it. The totals and the buckets of the files are tables with a version for each batch. A batch
reads the version before its own and replaces its own when it is repeated, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from podlens import names
from podlens.operators.enrich import enrich_with_metadata
from podlens.operators.metrics import (
    ALL_LABELS,
    CONTAINER_LABELS,
    duration_sum,
    metrics_reset,
    request_samples,
    with_reads,
)
from podlens.operators.rates import attach_rate, throttle_delay
from podlens.operators.sli import extract_sli_from_lines
from podlens.options import MetricOptions, ParseOptions, RateOptions
from podlens.sources.rules import RateRule
from podlens.streaming.history import indicators_as_of

EPOCH = "struct<start: timestamp, end: timestamp>"
_TOTALS = "epoch {epoch}, metric string, {labels}, value double".format(
    epoch=EPOCH, labels=", ".join(f"{label} string" for label in ALL_LABELS)
)
_FILES = "path string, namespace string, pod string, container string, busy_until double, waited double"


@dataclass(frozen=True)
class LiveOptions:
    parse: ParseOptions = ParseOptions()
    metrics: MetricOptions = MetricOptions()
    rates: RateOptions = RateOptions()
    slice_width: int = 1_000_000
    delay_digits: int | None = None


class LiveSamples:
    """The metrics of one stream; ``folder`` lasts as long as the checkpoint of the stream.

    ``catalog`` gives the containers of the moment, ``hosts`` the history of the service hosts, ``rules``
    the checked rate rules. All are asked once for each batch.

    A line has ``value`` and ``path``, ``seq`` (its place in the file, rising over all batches) and
    ``arrival`` (seconds). The counter of a reset period gets every line of that period, however late.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        catalog: Callable[[], DataFrame],
        hosts: Callable[[], DataFrame],
        rules: Callable[[], list[RateRule]] = list,
        options: LiveOptions = LiveOptions(),
    ) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")
        self._catalog, self._hosts, self._rules, self._options = catalog, hosts, rules, options

    def _version(self, table: str, batch: int, schema: str) -> DataFrame:
        if batch < 0:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(f"{self._folder}/{table}/{batch}")

    def _store(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self._folder}/{table}/{batch}")

    def totals(self, batch: int) -> DataFrame:
        """Samples of requests and lines by reset period, as of the end of a batch."""
        return self._version("totals", batch, _TOTALS)

    def files(self, batch: int) -> DataFrame:
        """The followed files: until when their bucket is used up, and how long their lines waited."""
        return self._version("files", batch, _FILES)

    def throttling(self, batch: int) -> DataFrame:
        """Delay by container, of the files followed at the end of a batch."""
        value = duration_sum(F.col("waited"), self._options.metrics.sum_scale)
        return self.files(batch).groupBy(*CONTAINER_LABELS).agg(value.alias("value"))

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Add one micro-batch."""
        catalog = self._catalog()
        lines = enrich_with_metadata(batch, catalog).persist()
        try:
            self._add_totals(lines, batch_id)
            self._add_delays(lines, catalog, batch_id)
        finally:
            lines.unpersist()

    def _add_totals(self, lines: DataFrame, batch_id: int) -> None:
        options = self._options.metrics
        narrow = lines.select("value", "path", "format")
        matched = indicators_as_of(extract_sli_from_lines(narrow, self._options.parse), self._hosts())
        requests = request_samples(metrics_reset(matched, "event_time", options), options, ["epoch"])
        # Lines count in the period in which they arrive, as many of them have no time of their own.
        arrived = lines.select(*CONTAINER_LABELS, "value", F.timestamp_seconds("arrival").alias("arrived"))
        read = with_reads(metrics_reset(arrived, "arrived", options), self._options.parse.max_line_bytes)
        counts = read.groupBy("epoch", *CONTAINER_LABELS).agg(F.sum("reads").cast("double").alias("value"))
        messages = counts.withColumn("metric", F.lit(names.M_MESSAGES))
        labels = [label for label in ALL_LABELS if label not in CONTAINER_LABELS]
        messages = messages.withColumns({label: F.lit(None).cast("string") for label in labels})
        columns = [F.col("epoch").cast(EPOCH).alias("epoch"), "metric", *ALL_LABELS, "value"]
        rows = self.totals(batch_id - 1).unionAll(requests.select(columns)).unionAll(messages.select(columns))
        value = duration_sum(F.col("value"), options.sum_scale)
        self._store(rows.groupBy("epoch", "metric", *ALL_LABELS).agg(value.alias("value")), "totals", batch_id)

    def _add_delays(self, lines: DataFrame, catalog: DataFrame, batch_id: int) -> None:
        known = lines.where(F.col("id").isNotNull()).select("value", "path", "seq", "arrival", *CONTAINER_LABELS)
        reads = with_reads(known, self._options.parse.max_line_bytes).drop("value")
        before = self.files(batch_id - 1)
        carried = before.select("path", "busy_until")
        rated = attach_rate(reads, catalog, self._rules(), self._options.rates)
        delayed = throttle_delay(rated, slice_width=self._options.slice_width, carried=carried)
        digits = self._options.delay_digits
        delay = F.col("delay") if digits is None else F.round("delay", digits)
        scale = self._options.metrics.sum_scale
        new = delayed.groupBy("path", *CONTAINER_LABELS).agg(
            F.max("busy_until").alias("busy_until"), duration_sum(delay, scale).alias("waited")
        )
        rows = before.unionByName(new).groupBy("path", *CONTAINER_LABELS)
        rows = rows.agg(F.max("busy_until").alias("busy_until"), duration_sum(F.col("waited"), scale).alias("waited"))
        # A series ends with its container: one that comes back begins at nothing.
        running = catalog.where("running").select("path").distinct()
        self._store(rows.join(running, "path", "left_semi"), "files", batch_id)


def stream_samples(lines: DataFrame, live: LiveSamples) -> DataStreamWriter:
    """Keep the metrics of ``live`` up to date with a stream; the caller adds checkpoint and trigger."""
    return lines.writeStream.foreachBatch(live.update)
