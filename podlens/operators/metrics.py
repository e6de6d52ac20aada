"""Counters and histograms over matched requests and over lines.

All of them are single aggregates with partial combination before the shuffle, so a service or
container that holds a large part of the rows is reduced in every task first. ``by`` adds key
columns, for instance a reset period.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podlens import names
from podlens.options import MetricOptions

REQUEST_LABELS = ("method", "service", "path", "upstream_pod_name")
CONTAINER_LABELS = ("namespace", "pod", "container")
ALL_LABELS = ("method", "service", "path", "status", "upstream_pod_name", *CONTAINER_LABELS, "le")


def duration_sum(value: Column, scale: int | None) -> Column:
    """Sum of durations as DOUBLE; with a scale it does not depend on the order of rows."""
    if scale is None:
        return F.sum(value)
    return F.sum(value.try_cast(f"decimal(28,{scale})")).cast("double")


def bound_text(bound: float) -> str:
    """How a bucket bound is written in the ``le`` label: the shortest digits that read back to it.

    With an exponent from 1e+06 on and below 1e-04.
    """
    if not math.isfinite(bound):
        return {math.inf: "+Inf", -math.inf: "-Inf"}.get(bound, "NaN")
    digits = Decimal(repr(float(bound))).normalize()
    if digits and not -5 < digits.adjusted() < 6:
        return f"{digits:.{len(digits.as_tuple().digits) - 1}e}".replace("e+", "e+0" if digits.adjusted() < 10 else "e+").replace(
            "e-", "e-0" if digits.adjusted() > -10 else "e-"
        )
    return f"{digits:f}"


def _labelled(matched: DataFrame) -> DataFrame:
    return matched.withColumnRenamed("pod_name", "upstream_pod_name")


def _hits(matched: DataFrame) -> DataFrame:
    return _labelled(matched).where(F.col("path") != "")


def http_request_count(matched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests by method, service, path, status and upstream pod; only where a path rule matched."""
    keys = [*by, "method", "service", "path", F.col("status").cast("string").alias("status"), "upstream_pod_name"]
    return _hits(matched).groupBy(*keys).agg(F.count("*").alias("value"))


def http_request_total_count(matched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests by service, with those that match no path rule."""
    return matched.groupBy(*by, "service").agg(F.count("*").alias("value"))


def _bucket_counts(value: Column, buckets: Sequence[float]) -> list[Column]:
    # A plain conditional count: count_if first computes one column per bucket for every row.
    return [F.count(F.when(value <= F.lit(bound), 1)) for bound in buckets]


def _histogram(
    rows: DataFrame, value: str, options: MetricOptions, by: Sequence[str]
) -> DataFrame:
    """One row per label set and bucket: ``le``, cumulative ``value``, and the ``sum`` and ``count``."""
    column = F.col(value)
    counts = F.array(*_bucket_counts(column, options.buckets), F.count(column))
    grouped = rows.groupBy(*by, *REQUEST_LABELS).agg(
        counts.alias("_counts"),
        duration_sum(column, options.sum_scale).alias("sum"),
        F.count(column).alias("count"),
    )
    bounds = F.array(*[F.lit(bound_text(b)) for b in options.buckets], F.lit("+Inf"))
    buckets = F.arrays_zip(bounds.alias("le"), F.col("_counts").alias("value"))
    return grouped.select(*by, *REQUEST_LABELS, "sum", "count", F.inline(buckets).alias("le", "value"))


def http_request_time(
    matched: DataFrame, options: MetricOptions = MetricOptions(), by: Sequence[str] = ()
) -> DataFrame:
    """Histogram of request times."""
    return _histogram(_hits(matched), "request_time", options, by)


def http_upstream_response_time_total(
    matched: DataFrame, options: MetricOptions = MetricOptions(), by: Sequence[str] = ()
) -> DataFrame:
    """Histogram of total upstream times, over the requests that have one."""
    present = _hits(matched).where(F.col("upstream_total").isNotNull())
    return _histogram(present, "upstream_total", options, by)


def with_reads(lines: DataFrame, max_bytes: int) -> DataFrame:
    """Column ``reads``: as how many entries a line is read, as one beyond ``max_bytes`` comes in pieces."""
    pieces = F.ceil(F.octet_length("value") / F.lit(max_bytes))
    return lines.withColumn("reads", F.greatest(F.coalesce(pieces, F.lit(1)), F.lit(1)).cast("long"))


def _reads(lines: DataFrame) -> Column:
    """The number of entries read: rows, or the sum of their ``reads`` where lines have them."""
    return F.sum("reads") if "reads" in lines.columns else F.count("*")


def log_message_count(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entries read per container, before parsing and with the suppressed ones.

    A line that is too long counts once for each of its pieces, if ``lines`` have ``reads``.
    """
    return lines.groupBy(*by, *CONTAINER_LABELS).agg(_reads(lines).alias("value"))


def metrics_reset(df: DataFrame, event_time: str, options: MetricOptions = MetricOptions()) -> DataFrame:
    """Column ``epoch`` (start and end): the reset period of a row, to group metrics by.

    It is an event-time window, so the same grouping works on a stream with a watermark.
    """
    return df.withColumn("epoch", F.window(F.col(event_time), f"{options.reset_seconds} seconds"))


def labels_column(columns: Sequence[str]) -> Column:
    """Map of the label columns that are not NULL."""
    parts: list[Column] = []
    for name in columns:
        parts += [F.lit(name), F.col(name)]
    return F.map_filter(F.create_map(*parts), lambda _, value: value.isNotNull())


def sample_text(metric: Column, labels: Column) -> Column:
    """``name{label="value",...}`` with sorted labels."""
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)),
        lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')),
    )
    return F.concat(metric, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _sample(metric: str, value: Column, **labels: Column) -> Column:
    fields = [F.lit(metric).alias("metric")]
    for name in ALL_LABELS:
        fields.append(labels.get(name, F.lit(None)).cast("string").alias(name))
    return F.struct(*fields, value.cast("double").alias("value"))


def _histogram_series(metric: str, options: MetricOptions) -> list[tuple[str, str | None]]:
    """Sample names of a histogram with their ``le``: the buckets, then sum and count."""
    bounds = [*(bound_text(b) for b in options.buckets), "+Inf"]
    return [*((f"{metric}_bucket", bound) for bound in bounds), (f"{metric}_sum", None), (f"{metric}_count", None)]


def _histogram_values(prefix: str) -> Column:
    """The values that go with :func:`_histogram_series`."""
    total, count = F.col(f"{prefix}_sum"), F.col(f"{prefix}_count").cast("double")
    return F.concat(F.col(f"{prefix}_buckets").cast("array<double>"), F.array(count, total, count))


def request_samples(
    matched: DataFrame, options: MetricOptions = MetricOptions(), by: Sequence[str] = ()
) -> DataFrame:
    """Samples of the four request metrics out of one pass over the requests.

    The requests are aggregated once at the finest label set; the metrics are sums over that
    small result.
    """
    finest = [*by, "method", "service", "path", "status", "upstream_pod_name"]
    aggregates = [F.count("*").cast("double").alias("n")]
    for prefix, name in (("time", "request_time"), ("upstream", "upstream_total")):
        value = F.col(name)
        aggregates += [
            F.array(*_bucket_counts(value, options.buckets)).alias(f"{prefix}_buckets"),
            duration_sum(value, options.sum_scale).alias(f"{prefix}_sum"),
            F.count(value).alias(f"{prefix}_count"),
        ]
    base = _labelled(matched).groupBy(*finest).agg(*aggregates)
    series = [
        (names.M_TOTAL, None),
        (names.M_REQUESTS, None),
        *_histogram_series(names.M_TIME, options),
        *_histogram_series(names.M_UPSTREAM, options),
    ]
    samples = F.arrays_zip(
        F.array(*[F.lit(metric) for metric, _ in series]).alias("metric"),
        F.array(*[F.lit(bound).cast("string") for _, bound in series]).alias("le"),
        F.concat(
            F.array("n", "n"), _histogram_values("time"), _histogram_values("upstream")
        ).alias("value"),
    )
    rows = base.select(*finest, "upstream_count", F.inline(samples).alias("metric", "le", "value"))
    metric = F.col("metric")
    total = metric == names.M_TOTAL
    observed = ~F.startswith(metric, F.lit(names.M_UPSTREAM)) | (F.col("upstream_count") > 0)
    status = F.when(metric == names.M_REQUESTS, F.col("status").cast("string"))
    labels = {
        "method": F.when(~total, F.col("method")),
        "service": F.col("service"),
        "path": F.when(~total, F.col("path")),
        "status": status,
        "upstream_pod_name": F.when(~total, F.col("upstream_pod_name")),
        "le": F.col("le"),
    }
    none = F.lit(None).cast("string")
    columns = [labels.get(name, none).alias(name) for name in ALL_LABELS]
    found = rows.where(total | ((F.col("path") != "") & observed)).select(*by, "metric", *columns, "value")
    # The exact sums are added once more here, with the same scale.
    value = duration_sum(F.col("value"), options.sum_scale)
    return found.groupBy(*by, "metric", *ALL_LABELS).agg(value.alias("value"))


def container_samples(
    delayed: DataFrame,
    options: MetricOptions = MetricOptions(),
    running: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Samples of the two container metrics out of one pass over the lines with their ``delay``.

    Given the running containers, only theirs have a throttling sample.
    """
    keys = list(CONTAINER_LABELS)
    totals = delayed.groupBy(*by, *keys).agg(
        _reads(delayed).alias("_lines"), duration_sum(F.col("delay"), options.sum_scale).alias("_delay")
    )
    live = F.lit(True)
    if running is not None:
        alive = running.where("running").select(*keys).distinct().withColumn("_live", F.lit(True))
        totals, live = totals.join(alive, keys, "left"), F.col("_live")
    labels = {name: F.col(name) for name in keys}
    messages = F.array(_sample(names.M_MESSAGES, F.col("_lines"), **labels))
    throttled = F.array(_sample(names.M_THROTTLE, F.col("_delay"), **labels))
    return totals.select(*by, F.inline(F.when(live, F.concat(messages, throttled)).otherwise(messages)))


def metric_samples(
    matched: DataFrame,
    delayed: DataFrame,
    options: MetricOptions = MetricOptions(),
    running: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """All six metrics as ``(metric, labels, value)``; histograms as bucket, sum and count samples.

    ``by`` adds key columns that both inputs have, for instance the reset period. ``matched`` are the requests, ``delayed`` all lines with their throttling delay. Each is read
    in one pass.
    """
    samples = request_samples(matched, options, by).unionByName(container_samples(delayed, options, running, by))
    return samples.select(*by, "metric", labels_column(ALL_LABELS).alias("labels"), "value")
