"""Small configuration files: lists of flat maps, as YAML or JSON."""

from __future__ import annotations

from pyspark.sql import SparkSession

try:
    import yaml
except ImportError:  # JSON files still work
    yaml = None


def read_list(spark: SparkSession, path: str, wrapper: str | None = None) -> list[dict[str, str | None]]:
    """The entries of one config file, with scalars as text.

    The top level must be a list; ``wrapper`` names a key under which the list may also stand.
    """
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one config file at {path}")
    entries = _load(rows[0]["value"])
    if wrapper and isinstance(entries, dict) and set(entries) == {wrapper}:
        entries = entries[wrapper]
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError(f"{path} must hold a list of maps")
    return entries


def _load(text: str):
    if yaml is not None:
        # The base loader leaves every scalar as the text it is written as.
        return yaml.load(text, Loader=yaml.BaseLoader)
    import json

    return json.loads(text, parse_int=str, parse_float=str)
