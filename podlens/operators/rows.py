"""Derived columns that later filters must not pull apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """Add columns to every row, or only to the rows to ``keep``; the others are dropped.

    A filter above a projection is pushed below it, which evaluates a costly expression once for
    the filter and once more for its value. It is not pushed below a generator, so the columns are
    emitted by one. ``keep`` is tested before the columns are evaluated.
    """
    row = F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))
    return df.select("*", F.inline(row if keep is None else F.when(keep, row)))
