"""The streaming jobs: records to a sink, and live metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from podlens.operators.enrich import enrich_with_metadata
from podlens.operators.journal import normalise_journal
from podlens.operators.metrics import (
    http_request_count,
    http_request_time,
    http_request_total_count,
    http_upstream_response_time_total,
    log_message_count,
    metrics_reset,
)
from podlens.operators.output import to_json_lines, union_outputs
from podlens.operators.sli import extract_sli_from_lines, indicators
from podlens.options import DeliveryOptions, MetricOptions, ParseOptions, StaticMetadata
from podlens.plans.records import record_lines
from podlens.sources.journal import journal_rows
from podlens.streaming.sinks import Sink, deliver_batches


def stream_records(
    lines: DataFrame,
    catalog: Callable[[], DataFrame],
    emit: Callable[[DataFrame, int], None],
    options: ParseOptions = ParseOptions(),
    static: StaticMetadata = StaticMetadata(),
    metrics: Callable[[DataFrame, int], None] | None = None,
    delivery: DeliveryOptions = DeliveryOptions(),
    journal: DataFrame | None = None,
) -> DataStreamWriter:
    """Lines to JSON records, micro-batch by micro-batch; the caller adds the checkpoint.

    ``journal`` is a stream of exported journal rows (``value``). Both sources are read by one query with
    an offset each, and the messages of both go out as one batch under one key.

    Messages wait for at most ``delivery.flush_seconds``: that is the interval of the micro-batches,
    unless the caller sets another trigger.

    ``catalog`` gives the container catalog of the moment. ``metrics`` gets the enriched lines of
    the same micro-batch, which are then stored once for both.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        # What several readers share is stored: otherwise each of them would read the sources again.
        stored = [batch.persist()] if journal is not None else []
        try:
            own = batch if journal is None else batch.where(~F.col("_journal")).drop("_journal")
            enriched = enrich_with_metadata(own, catalog(), static)
            if metrics is not None:
                stored.append(enriched.persist())
                metrics(enriched, batch_id)
            messages = record_lines(enriched, options)
            if journal is not None:
                rows = journal_rows(batch.where("_journal").select("value"))
                messages = union_outputs(messages, to_json_lines(normalise_journal(rows, options, static)))
            emit(messages, batch_id)
        finally:
            for frame in stored:
                frame.unpersist()

    if journal is not None:
        rows = journal.select("value", F.lit(True).alias("_journal"))
        lines = lines.withColumn("_journal", F.lit(False)).unionByName(rows, allowMissingColumns=True)
    return lines.writeStream.foreachBatch(process).trigger(processingTime=f"{delivery.flush_seconds} seconds")


def emit_to_sink(
    open_sink: Callable[[], Sink], job: str, options: DeliveryOptions = DeliveryOptions()
) -> Callable[[DataFrame, int], None]:
    """An ``emit`` that sends every micro-batch to a sink.

    ``job`` is as lasting as the checkpoint of the stream: a new checkpoint needs a new name.
    """

    def emit(messages: DataFrame, batch_id: int) -> None:
        deliver_batches(messages, open_sink, job, options, batch_id)

    return emit


def stream_indicators(
    lines: DataFrame,
    hosts: DataFrame,
    watermark: str,
    options: ParseOptions = ParseOptions(),
    metric_options: MetricOptions = MetricOptions(),
) -> DataFrame:
    """Matched requests of a stream with their reset period, ready to be aggregated.

    Requests later than ``watermark`` behind the newest one no longer count, so it must be longer
    than lines are ever late; the query's progress reports how many rows were dropped.
    """
    requests = extract_sli_from_lines(lines, options)
    matched = indicators(requests, hosts).withWatermark("event_time", watermark)
    return metrics_reset(matched, "event_time", metric_options)


METRICS = {
    "http_request_count": lambda matched, options, by: http_request_count(matched, by),
    "http_request_total_count": lambda matched, options, by: http_request_total_count(matched, by),
    "http_request_time": http_request_time,
    "http_upstream_response_time_total": http_upstream_response_time_total,
    "log_message_count": lambda lines, options, by: log_message_count(lines, by),
}


def stream_metrics(
    matched: DataFrame,
    metric: str,
    options: MetricOptions = MetricOptions(),
    by: Sequence[str] = ("epoch",),
) -> DataFrame:
    """One metric over a stream: ``update`` mode for live values, ``append`` for final ones.

    ``matched`` are the requests; for ``log_message_count`` lines with their container and period.

    State is one row per label set and period; the watermark drops it when the period is over.
    """
    return METRICS[metric](matched, options, by)
