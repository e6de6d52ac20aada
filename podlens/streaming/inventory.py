"""What changes from one snapshot of the containers to the next."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podlens import names

STARTED, FINISHED, STOPPED, ORPHANED, UNIGNORED = "started", "finished", "stopped", "orphaned", "unignored"
_STATE = "path string, known boolean, followed boolean, ignored boolean"


def inventory_step(state: DataFrame, catalog: DataFrame) -> DataFrame:
    """The next state of every path with its ``changes``, from one join of the state and a snapshot.

    A state has a row for each path: ``known`` (it has a stored position), ``followed`` and ``ignored``
    (it was read to its end). In a snapshot (``path``, ``running``)

    - ``started``: present, neither followed nor ignored. It is followed from now on.
    - ``finished``: followed and present, but no longer running. It is read to its end and then ignored.
    - ``stopped``: followed and gone.
    - ``orphaned``: its position is known, but it is gone. The position goes; that of the journal never does.
    - ``unignored``: ignored and gone.
    """
    snapshot = catalog.groupBy("path").agg(F.max("running").alias("running"))
    both = state.join(snapshot.withColumn("present", F.lit(True)), "path", "full_outer")
    flags = {name: F.coalesce(name, F.lit(False)) for name in ("known", "followed", "ignored", "present", "running")}
    both = both.select("path", *[flag.alias(name) for name, flag in flags.items()])
    known, followed, ignored, present, running = (F.col(name) for name in flags)
    journal = F.col("path") == names.JOURNAL_LEDGER_KEY
    changes = {
        STARTED: present & ~followed & ~ignored,
        FINISHED: present & followed & ~running,
        STOPPED: followed & ~present,
        ORPHANED: known & ~present & ~journal,
        UNIGNORED: ignored & ~present,
    }
    rows = both.select("*", *[change.alias(f"_{name}") for name, change in changes.items()])
    started, finished = F.col(f"_{STARTED}"), F.col(f"_{FINISHED}")
    found = rows.select(
        "path",
        (journal & known | present & (known | started)).alias("known"),
        (present & (followed & running | started)).alias("followed"),
        (present & (ignored | finished)).alias("ignored"),
        F.array_compact(F.array(*[F.when(F.col(f"_{name}"), F.lit(name)) for name in changes])).alias("changes"),
    )
    return found.where(F.col("known") | F.col("followed") | F.col("ignored") | (F.size("changes") > 0))


class LiveInventory:
    """Follows the containers from snapshot to snapshot; the state is a table with a version for each.

    ``folder`` lasts as long as the positions of the followed files. ``turn`` numbers the snapshots; the
    same turn again replaces what it gave, so a job that broke off repeats its last one.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")

    def _state(self, turn: int) -> DataFrame:
        if turn < 0:
            return self._spark.createDataFrame([], _STATE)
        try:
            return self._spark.read.parquet(f"{self._folder}/{turn}").select("path", "known", "followed", "ignored")
        except AnalysisException as error:
            raise LookupError(f"no snapshot was observed in turn {turn}") from error

    def observe(self, catalog: DataFrame, turn: int) -> DataFrame:
        """``(path, change)`` rows of a snapshot against the turn before it."""
        step = inventory_step(self._state(turn - 1), catalog)
        step.write.mode("overwrite").parquet(f"{self._folder}/{turn}")
        return self._spark.read.parquet(f"{self._folder}/{turn}").select("path", F.explode("changes").alias("change"))

    def followed(self, turn: int) -> DataFrame:
        return self._state(turn).where("followed").select("path")
