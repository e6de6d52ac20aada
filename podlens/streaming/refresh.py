"""Small tables that are read again at an interval."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from podlens.session import scratch_dir


class RefreshingTable:
    """Keeps a stored snapshot of a small table and renews it when it is older than ``seconds``.

    The snapshot is a table in the shared scratch folder, so it survives lost executors and every
    use within the interval sees the same rows. When loading fails, the old snapshot stays, and
    ``last_error`` says why. Every snapshot has a folder of its own, which is never written again, so
    a query that still reads an old one is not disturbed.
    """

    def __init__(
        self,
        spark: SparkSession,
        load: Callable[[], DataFrame],
        seconds: float,
        label: str = "catalog",
        clock: Callable[[], float] = time.monotonic,
    ) -> None:
        self._spark, self._load, self._seconds = spark, load, seconds
        self._folder, self._clock = scratch_dir(spark, label), clock
        self._turn = 0
        self._taken: float | None = None
        self._current: DataFrame | None = None
        self.last_error: Exception | None = None

    def current(self) -> DataFrame:
        now = self._clock()
        if self._current is None or now - self._taken >= self._seconds:
            self._renew(now)
        return self._current

    def _renew(self, now: float) -> None:
        try:
            path = f"{self._folder}/{self._turn}"
            self._load().write.parquet(path)
            self._current = self._spark.read.parquet(path)
            self._turn += 1
            self.last_error = None
        except Exception as error:
            if self._current is None:
                raise
            self.last_error = error
        self._taken = now


class RefreshingValue:
    """The same for a plain value, such as the rate rules; ``merge`` decides what replaces the old."""

    def __init__(
        self,
        load: Callable[[], object],
        merge: Callable[[object, object], object],
        initial: object,
        seconds: float,
        clock: Callable[[], float] = time.monotonic,
    ) -> None:
        self._load, self._merge, self._value = load, merge, initial
        self._seconds, self._clock = seconds, clock
        self._taken: float | None = None
        self.last_error: Exception | None = None

    def current(self) -> object:
        now = self._clock()
        if self._taken is None or now - self._taken >= self._seconds:
            try:
                self._value = self._merge(self._value, self._load())
                self.last_error = None
            except Exception as error:
                self.last_error = error
            self._taken = now
        return self._value
