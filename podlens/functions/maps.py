"""Functions on records, which are MAP<STRING, VARIANT> columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from podlens import names
from podlens.functions.variants import bind, fields_of, no_fields, text_of


def extend_map(*maps: Column) -> Column:
    """All maps together; entries of a later one win."""
    return F.map_concat(*maps)


def project_keys(record: Column, keys: Iterable[str]) -> Column:
    """Only the listed keys, as far as they exist."""
    wanted = list(keys)
    return F.map_filter(record, lambda key, _: key.isin(wanted))


def drop_keys(record: Column, keys: Iterable[str]) -> Column:
    unwanted = list(keys)
    return F.map_filter(record, lambda key, _: ~key.isin(unwanted))


def literal_fields(fields: dict[str, str]) -> Column:
    """A constant record with string values."""
    if not fields:
        return no_fields()
    parts: list[Column] = []
    for key, value in fields.items():
        parts += [F.lit(key), F.lit(value).cast("variant")]
    return F.create_map(*parts)


def group(key: str, fields: Column) -> Column:
    """A one-entry record with ``fields`` as an object under ``key``."""
    return F.create_map(F.lit(key), F.to_variant_object(fields))


def _label(record: Column, key: str) -> Column:
    return F.coalesce(text_of(record[key]), F.lit(""))


def namespace_of(record: Column) -> Column:
    """Namespace of a record, ``""`` when absent or not a string."""
    return _label(record, names.META_NAMESPACE)


def pod_of(record: Column) -> Column:
    return _label(record, names.META_POD)


def container_of(record: Column) -> Column:
    return _label(record, names.META_CONTAINER)


def _expand(entries: Column) -> Column:
    """Replace every object entry by its fields under dotted keys."""
    return F.flatten(
        F.transform(
            entries,
            lambda e: F.coalesce(
                F.transform(
                    F.map_entries(fields_of(e["value"])),
                    lambda child: F.struct(
                        F.concat(e["key"], F.lit("."), child["key"]).alias("key"),
                        child["value"].alias("value"),
                    ),
                ),
                F.array(e),
            ),
        )
    )


def _has_object(entries: Column) -> Column:
    return F.exists(entries, lambda e: fields_of(e["value"]).isNotNull())


def flatten_entries(record: Column) -> Column:
    """Nested objects become dotted keys, at any depth; arrays and nulls stay as they are.

    Where two fields come to the same key, the later one counts. Most records nest one or two
    levels, which are opened one after the other. Deeper ones go through a fold whose every round
    opens one level, with as many rounds as the record has opening braces; a round that finds
    nothing to open passes its state on.
    """

    def state(entries: Column) -> Column:
        return F.struct(entries.alias("entries"), _has_object(entries).alias("open"))

    def round_of(current: Column, _: Column) -> Column:
        return F.when(current["open"], bind(_expand(current["entries"]), state)).otherwise(current)

    def fold(entries: Column) -> Column:
        text = F.to_json(F.to_variant_object(record))
        depth = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
        start = F.struct(entries.alias("entries"), F.lit(True).alias("open"))
        return F.aggregate(F.sequence(F.lit(1), depth), start, round_of)["entries"]

    def opened(entries: Column, deeper: Callable[[Column], Column]) -> Column:
        return bind(_expand(entries), lambda once: F.when(_has_object(once), deeper(once)).otherwise(once))

    levels = opened(F.map_entries(record), lambda once: opened(once, fold))
    nested = F.exists(F.map_values(record), lambda value: fields_of(value).isNotNull())
    return F.when(nested, F.map_from_entries(levels)).otherwise(record)
