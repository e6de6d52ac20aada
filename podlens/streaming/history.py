"""Small catalogs with the time in which each of their rows was in force."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podlens.operators.sli import labelled
from podlens.session import small_side

FROM, UNTIL = "valid_from", "valid_to"


class CatalogHistory:
    """Rows of a catalog by ``key``, each with the interval ``[valid_from, valid_to)`` of its validity.

    ``record`` compares a snapshot with the rows in force: what is the same goes on, what differs or is
    gone ends, what is new begins. The first snapshot is valid from ever on, as a job starts with the
    catalog it finds; an open end is NULL. So a host that never changes has one row, however often the
    catalog is read.

    Every change is a new version in ``folder``, named by a commit record once it is complete. A job that
    starts again with the same folder goes on with the last one.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "host") -> None:
        self._spark, self._folder, self._key = spark, folder.rstrip("/"), key
        self._version, self._latest = -1, None
        try:
            commits = spark.read.schema("version long, at timestamp").parquet(f"{self._folder}/commits/*")
            last = commits.agg(F.max("version"), F.max("at").cast("double")).first()
        except AnalysisException:
            last = None  # no commit yet
        if last is not None and last[0] is not None:
            self._version, self._latest = last[0], datetime.fromtimestamp(last[1], timezone.utc)

    @property
    def empty(self) -> bool:
        return self._version < 0

    def table(self) -> DataFrame:
        """All rows with their intervals, as of the last change."""
        if self.empty:
            raise LookupError("no snapshot was recorded")
        return self._spark.read.parquet(f"{self._folder}/data/{self._version}")

    def record(self, snapshot: DataFrame, at: datetime) -> bool:
        """Take over a snapshot that is in force from ``at`` on; tells whether anything changed.

        Times only go forward, as an interval that was joined with requests must not change behind them.
        """
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        if self._latest is not None and at < self._latest:
            raise ValueError(f"{at} lies before the last change at {self._latest}")
        no_time = F.lit(None).cast("timestamp")
        if self.empty:
            self._write(snapshot.select("*", no_time.alias(FROM), no_time.alias(UNTIL)), at)
            return True
        known, key = self.table(), self._key
        values = [name for name in known.columns if name not in (key, FROM, UNTIL)]
        open_, closed = known.where(F.col(UNTIL).isNull()), known.where(F.col(UNTIL).isNotNull())
        both = _keyed(open_, key, values, "old").join(_keyed(snapshot, key, values, "new"), key, "full_outer")
        same = F.col("old.content").eqNullSafe(F.col("new.content"))
        changes = both.where(~same)
        if not changes.take(1):
            return False
        moment = F.lit(at)
        ended = F.struct("old.row.*", F.col(f"old.{FROM}").alias(FROM), moment.alias(UNTIL))
        kept = F.struct("old.row.*", F.col(f"old.{FROM}").alias(FROM), no_time.alias(UNTIL))
        begun = F.struct("new.row.*", moment.alias(FROM), no_time.alias(UNTIL))
        there, comes = F.col("old.content").isNotNull(), F.col("new.content").isNotNull()
        # What began at this very moment was never in force.
        lasted = there & F.coalesce(F.col(f"old.{FROM}") < moment, F.lit(True))
        rows = F.when(same, F.array(kept)).otherwise(
            F.array_compact(F.array(F.when(lasted, ended), F.when(comes, begun)))
        )
        fresh = both.select(key, F.explode(rows).alias("row")).select(key, "row.*")
        self._write(closed.unionByName(fresh), at)
        return True

    def forget(self, before: datetime) -> None:
        """Leave out what ended before a time that no request lies behind any more."""
        rows = self.table()
        self._write(rows.where(F.col(UNTIL).isNull() | (F.col(UNTIL) > F.lit(before))), self._latest)

    def _write(self, rows: DataFrame, at: datetime) -> None:
        version = self._version + 1
        rows.write.mode("overwrite").parquet(f"{self._folder}/data/{version}")
        commit = self._spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(at).alias("at"))
        commit.write.mode("overwrite").parquet(f"{self._folder}/commits/{version}")
        self._version, self._latest = version, at


def _keyed(rows: DataFrame, key: str, values: list[str], side: str) -> DataFrame:
    row = F.struct(*values)
    times = [F.col(FROM).alias(FROM)] if FROM in rows.columns else []
    return rows.select(key, F.struct(row.alias("row"), F.to_json(row).alias("content"), *times).alias(side))


class RefreshingHistory:
    """A history that loads its catalog again when the last load is older than ``seconds``.

    ``clock`` gives the time of the next batch in seconds since the epoch: that of the machine for a live
    job, that of the events for a replay. When loading fails the rows in force stay, and ``last_error``
    says why; only the first load must succeed.
    """

    def __init__(
        self,
        history: CatalogHistory,
        load: Callable[[], DataFrame],
        seconds: float,
        clock: Callable[[], float] = time.time,
    ) -> None:
        self.history, self._load, self._seconds, self._clock = history, load, seconds, clock
        self._taken: float | None = None
        self.last_error: Exception | None = None

    def current(self) -> DataFrame:
        now = self._clock()
        if self._taken is None or now - self._taken >= self._seconds:
            try:
                self.history.record(self._load(), datetime.fromtimestamp(now, timezone.utc))
                self.last_error = None
            except Exception as error:
                if self.history.empty:
                    raise
                self.last_error = error
            self._taken = now
        return self.history.table()


def in_force(event_time: Column) -> Column:
    """Whether an event lies in the interval of a row; an event without a time takes the row in force now."""
    from_then = F.col(FROM).isNull() | (event_time >= F.col(FROM))
    until_then = F.col(UNTIL).isNull() | (event_time < F.col(UNTIL))
    return F.when(event_time.isNull(), F.col(UNTIL).isNull()).otherwise(from_then & until_then)


def as_of(rows: DataFrame, history: DataFrame, key: str = "host", event_time: str = "event_time") -> DataFrame:
    """Rows joined with what the catalog said about their key when they happened; others are left out.

    It is an equality join on the key with the interval as a further condition, so a row meets only the
    versions of its own key. A history of measured small size is broadcast; otherwise both sides are
    shuffled, and adaptive execution splits the rows of a hot key.
    """
    versions = small_side(history.withColumnRenamed(key, "_key"))
    condition = (F.col(key) == F.col("_key")) & in_force(F.col(event_time))
    return rows.join(versions, condition).drop("_key", FROM, UNTIL)


def indicators_as_of(requests: DataFrame, history: DataFrame, event_time: str = "event_time") -> DataFrame:
    """Requests with the ``service`` and ``path`` by the services in force at their time."""
    return labelled(history, lambda prepared: as_of(requests, prepared, "host", event_time))
