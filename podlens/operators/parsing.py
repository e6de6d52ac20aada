"""Line parsing: raw lines to the three field groups ``user``, ``cri`` and ``ext``.

The groups stay separate until :func:`assemble_record`, so where they end up is decided once, at
the end. Values that are used several times are columns of their own, so each line is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podlens import names
from podlens.functions.documents import document, document_fields, document_value
from podlens.functions.lines import (
    cri_content,
    cri_fields,
    cri_head,
    cri_time,
    docker_time,
    event_time,
    raw_fields,
    user_fields,
    with_derived,
)
from podlens.functions.maps import drop_keys, extend_map, group
from podlens.functions.upstream import last_time_text, total_time_text
from podlens.functions.variants import FIELDS, is_number, no_fields, text_of
from podlens.operators.rows import settle
from podlens.options import ParseOptions

ERROR_FORMAT = "line format is not known"
ERROR_OUTER = "line is not a JSON object"
ERROR_NO_LOG = "line has no payload field"
ERROR_LOG_TYPE = "payload field is not text"
ERROR_CRI = "line does not have the CRI shape"


def line_content(lines: DataFrame, line_format: Column, outer_type: str = FIELDS) -> DataFrame:
    """Split each line by its format: adds ``content`` and, for the caller, ``_outer`` and ``_head``.

    ``content`` is the payload text, NULL where the line does not have the shape of its format.
    ``_outer`` holds the fields of a Docker line, ``_head`` what comes before a CRI payload.
    """
    value = F.col("value")
    docker = line_format == names.FORMAT_DOCKER
    containerd = line_format == names.FORMAT_CRI
    split = lines.select(
        "*",
        F.when(docker, document(value, outer_type)).alias("_line"),
        F.when(containerd, cri_head(value)).alias("_head"),
    )
    read = document_fields if outer_type == FIELDS else document_value
    outer = split.select("*", read(F.col("_line"), value).alias("_outer")).drop("_line")
    content = F.when(docker, text_of(F.col("_outer")[names.KEY_LOG])).when(
        containerd, cri_content(value, F.col("_head"))
    )
    return outer.select("*", content.alias("content"))


def _with_user(rows: DataFrame, options: ParseOptions) -> DataFrame:
    """Column ``user`` from ``content``.

    Upstream times come from the top level of the payload, before it is flattened.
    """
    content, fields, source = F.col("content"), F.col("_fields"), F.col("_source")
    parsed = rows.select("*", document(content).alias("_doc"))
    found = parsed.select("*", document_fields(F.col("_doc"), content).alias("_fields")).drop("_doc")
    # The source field is settled: a map lookup counts as cheap and would be repeated at every use.
    found = settle(found, {"_source": fields[names.KEY_UPSTREAM_TIME]})
    typed = found.select(
        "*", F.when(is_number(source), source).alias("_number"), text_of(source).alias("_text")
    ).drop("_source")
    last = F.coalesce("_number", last_time_text(F.col("_text")).cast("variant"))
    total = F.coalesce("_number", total_time_text(F.col("_text")).cast("variant"))
    times = typed.select("*", last.alias("_last"), total.alias("_total")).drop("_number", "_text")
    timed = times.select("*", with_derived(fields, F.col("_last"), F.col("_total")).alias("_timed"))
    user = user_fields(F.col("_timed"), content, options.raw_key, options.flatten)
    return timed.drop("_fields", "_last", "_total").select("*", user.alias("user")).drop("_timed")


def parse_user_payload(rows: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """``content`` to ``user``: JSON objects become fields, any other text goes under the raw key."""
    settled = settle(_with_user(rows, options), {"_user": F.col("user")})
    return settled.drop("user").withColumnRenamed("_user", "user")


def _parse(lines: DataFrame, line_format: Column, options: ParseOptions) -> DataFrame:
    docker = line_format == names.FORMAT_DOCKER
    containerd = line_format == names.FORMAT_CRI
    shaped = F.col("content").isNotNull()
    outer, head = F.col("_outer"), F.col("_head")
    # A line that is JSON null parses, but holds no log field.
    unparsed = outer.isNull() & (F.trim("value") != "null")
    error = (
        F.when(shaped, F.lit(None).cast("string"))
        .when(containerd, F.lit(ERROR_CRI))
        .when(~docker, F.lit(ERROR_FORMAT))
        .when(unparsed, F.lit(ERROR_OUTER))
        .when(outer[names.KEY_LOG].isNull(), F.lit(ERROR_NO_LOG))
        .otherwise(F.lit(ERROR_LOG_TYPE))
    )
    cri = F.when(shaped & docker, drop_keys(outer, [names.KEY_LOG])).when(shaped & containerd, cri_fields(head))
    time = F.when(shaped & docker, docker_time(outer)).when(shaped & containerd, cri_time(head))
    known = line_content(lines.drop("event_time"), line_format).select(
        "*", cri.alias("_cri"), error.alias("_error"), event_time(time).alias("_time")
    )
    parsed = _with_user(known.drop("_outer", "_head"), options)
    whole = raw_fields(F.col("value"), options.raw_key)
    result = {
        "user": F.when(F.col("content").isNotNull(), F.col("_user")).otherwise(whole),
        "cri": F.col("_cri"),
        "parse_error": F.col("_error"),
        "event_time": F.col("_time"),
    }
    settled = settle(parsed.withColumnRenamed("user", "_user"), result)
    return settled.drop("content", "_user", "_cri", "_error", "_time")


def parse_docker_lines(lines: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Docker JSON lines to ``user``, ``cri``, ``parse_error`` and ``event_time``."""
    return _parse(lines, F.lit(names.FORMAT_DOCKER), options)


def parse_cri_lines(lines: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """CRI lines to the same columns; ``cri`` holds time and stream."""
    return _parse(lines, F.lit(names.FORMAT_CRI), options)


def parse_lines(lines: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Parse every line by its ``format``; no line is ever dropped.

    Adds ``user``, ``cri``, ``parse_error`` (NULL where the line had the right shape) and
    ``event_time`` (the time the runtime wrote).
    """
    return _parse(lines, F.col("format"), options)


def parse_fallback_raw(lines: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """The whole line under the raw key, without CRI fields."""
    return lines.select(
        "*",
        raw_fields(F.col("value"), options.raw_key).alias("user"),
        F.lit(None).cast(FIELDS).alias("cri"),
    )


def record_column(user: Column, cri: Column, ext: Column, options: ParseOptions) -> Column:
    """One record out of the three groups.

    At the top level user fields win over CRI fields, and metadata wins over both. A group key
    that names another group merges with it (metadata) or replaces it (user over CRI).
    """
    has_cri = F.coalesce(F.size(cri) > 0, F.lit(False))
    known_cri = F.coalesce(cri, no_fields())

    if options.cri_key:
        low = F.when(has_cri, group(options.cri_key, known_cri)).otherwise(no_fields())
    else:
        low = known_cri
    high = group(options.user_key, user) if options.user_key else user

    if not options.ext_key:
        return extend_map(low, high, ext)
    base = extend_map(low, high)
    alone = group(options.ext_key, ext)
    if options.ext_key == options.user_key:
        return extend_map(base, group(options.ext_key, extend_map(user, ext)))
    if options.ext_key == options.cri_key:
        merges = has_cri
        if not options.user_key:
            merges = merges & ~F.map_contains_key(user, options.cri_key)
        joined = F.when(merges, group(options.ext_key, extend_map(known_cri, ext))).otherwise(alone)
        return extend_map(base, joined)
    return extend_map(base, alone)


def ext_column(df: DataFrame) -> Column:
    """The metadata group, empty where there is none."""
    return F.coalesce(F.col("ext"), no_fields()) if "ext" in df.columns else no_fields()


def assemble_record(parsed: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Column ``record`` from the groups, which are dropped."""
    record = record_column(F.col("user"), F.col("cri"), ext_column(parsed), options)
    return settle(parsed, {"record": record}).drop("user", "cri", "ext")
