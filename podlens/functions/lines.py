"""Parts of one line, as expressions over its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from podlens import names
from podlens.functions.maps import extend_map, flatten_entries
from podlens.functions.variants import no_fields, text_of

# Fixed value: time, stream, tag and the blank before the content. The greedy start makes the
# last " stdout X " or " stderr X " of the line the split point.
CRI_HEAD = r"(?s)^(.+ (?:stdout|stderr) . )"
# Length of " stdout X ", the part of the head that follows the time.
CRI_TAIL = 10


def cri_head(line: Column) -> Column:
    """Everything before the content of a CRI line, ``""`` when the line has another shape."""
    return F.regexp_extract(line, CRI_HEAD, 1)


def cri_content(line: Column, head: Column) -> Column:
    return F.when(F.length(head) > 0, F.substring(line, F.length(head) + 1, F.length(line)))


def cri_time(head: Column) -> Column:
    return F.substring(head, F.lit(1), F.length(head) - CRI_TAIL)


def cri_fields(head: Column) -> Column:
    """Time and stream. The tag is ignored; partial lines are not joined again."""
    stream = F.substring(head, F.length(head) - (CRI_TAIL - 2), F.lit(6))
    return F.create_map(
        F.lit(names.KEY_TIME),
        cri_time(head).cast("variant"),
        F.lit(names.KEY_STREAM),
        stream.cast("variant"),
    )


def raw_fields(text: Column, raw_key: str) -> Column:
    """A line or payload that is no JSON object, under the raw key."""
    return F.create_map(F.lit(raw_key), F.make_valid_utf8(text).cast("variant"))


def derived_times(last: Column, total: Column) -> Column:
    """The upstream times that exist. There is a total wherever there is a last time."""
    total_part = (F.lit(names.KEY_UPSTREAM_TOTAL), total)
    both = F.create_map(F.lit(names.KEY_UPSTREAM_LAST), last, *total_part)
    return (
        F.when(last.isNotNull(), both).when(total.isNotNull(), F.create_map(*total_part)).otherwise(no_fields())
    )


def with_derived(fields: Column, last: Column, total: Column) -> Column:
    """Fields with the upstream times, where there are any."""
    return F.when(total.isNotNull(), extend_map(fields, derived_times(last, total))).otherwise(fields)


def user_fields(timed: Column, content: Column, raw_key: str = "msg", flatten: bool = True) -> Column:
    """User fields of a payload: those of an object, flattened; any other text under the raw key."""
    full = flatten_entries(timed) if flatten else timed
    return F.when(timed.isNotNull(), full).otherwise(raw_fields(content, raw_key))


def event_time(time: Column) -> Column:
    """The time the container runtime wrote, as a timestamp; finer than microseconds is cut."""
    return time.try_cast("timestamp")


def docker_time(outer: Column) -> Column:
    return text_of(outer[names.KEY_TIME])
