"""A stream over many growing files: folders are listed by tasks, positions lie in a stored ledger.

The offset is the name of a ledger version, a rising number, whatever the number of files. A micro-batch
has a task for each shard. A shard owns the entries of the first folder level that the pattern leaves
open, by a hash of their names. Its task reads the shard's part of the version before, lists its own
entries, decides how far every file is read, stores that as its part of the new version, and then
reads. A part is stored once: a task that is repeated finds it and reads the same bytes again. So the
driver neither lists files nor holds positions.

Executors must see files and ledger under the same paths.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import re
import shutil
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from podlens.session import pickle_by_value
from podlens.streaming.tail import SCHEMA, ByteRange, _find, _key, _stat, last_line_end, read_range

MAGIC = re.compile(r"[*?\[]")
MARK_BYTES = 1024


def owned(pattern: str, shard: int, shards: int) -> Iterator[str]:
    """Files of a pattern that belong to a shard, by the first part of their path that the pattern leaves open."""
    parts = pattern.split("/")
    first = next((i for i, part in enumerate(parts) if MAGIC.search(part)), len(parts) - 1)
    base, rest = "/".join(parts[:first]) or "/", parts[first + 1 :]
    for name in sorted(_entries(base, parts[first])):
        if zlib.crc32(name.encode("utf-8", "surrogateescape")) % shards == shard:
            path = f"{base.rstrip('/')}/{name}"
            yield from sorted(glob.glob("/".join([glob.escape(path), *rest]), recursive=True)) if rest else [path]


def _entries(base: str, part: str) -> list[str]:
    if part == "**":
        raise ValueError("the first open part of a pattern cannot be **")
    return glob.glob(part, root_dir=base)


def mark_of(path: str, position: int) -> str:
    """A digest of the bytes at the beginning of a file and just before a position in it."""
    try:
        with open(path, "rb") as file:
            first = file.read(min(position, MARK_BYTES))
            file.seek(max(0, position - MARK_BYTES))
            return hashlib.md5(first + file.read(min(position, MARK_BYTES))).hexdigest()
    except OSError:
        return ""


class Shard(InputPartition):
    """One task: the shard's part of version ``before`` is read, that of ``after`` is made."""

    def __init__(self, shard: int, before: int, after: int) -> None:
        super().__init__(shard)
        self.shard, self.before, self.after = shard, before, after


class LedgerTailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.pattern, self.ledger = options["path"], options["ledger"].rstrip("/")
        self.shards = int(options.get("shards", 32))
        self.from_tail = options.get("fromtail", "false").lower() == "true"
        self.max_bytes = int(options["maxbytesperfile"]) if "maxbytesperfile" in options else None
        if not MAGIC.search(self.pattern):
            raise ValueError("the pattern must leave a part of the path open")
        self.last = 0

    def initialOffset(self) -> dict:  # noqa: N802 (interface name)
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802 (interface name)
        # A number that no earlier run has used: time goes on between the runs of a job.
        self.last = max(self.last + 1, time.time_ns() // 1_000_000)
        return {"version": self.last}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(shard, start["version"], end["version"]) for shard in range(self.shards)]

    def commit(self, end: dict) -> None:
        """Versions before the one that the next batch reads are not needed any more."""
        for name in os.listdir(self.ledger) if os.path.isdir(self.ledger) else []:
            if name.isdigit() and int(name) < end["version"]:
                shutil.rmtree(f"{self.ledger}/{name}", ignore_errors=True)

    def _part(self, version: int, shard: int) -> str:
        return f"{self.ledger}/{version}/{shard}.json"

    def _load(self, version: int, shard: int) -> dict | None:
        try:
            with open(self._part(version, shard), encoding="utf-8") as file:
                return json.load(file)
        except FileNotFoundError:
            return None

    def _store(self, version: int, shard: int, plan: dict) -> dict:
        """Store a part unless another attempt of the task did; what is stored counts."""
        target = self._part(version, shard)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        temporary = f"{target}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as file:
            json.dump(plan, file)
        try:
            os.link(temporary, target)
        except FileExistsError:
            pass
        finally:
            os.unlink(temporary)
        return self._load(version, shard)

    def plan(self, shard: int, before: dict[str, list], first: bool) -> dict:
        """Positions of the shard's files after this batch, and the byte ranges that lead there."""
        files, reads = {}, []
        for path in owned(self.pattern, shard, self.shards):
            stat = _stat(path)
            if stat is None or not os.path.isfile(path) or _key(stat) in files:
                continue
            key = _key(stat)
            done = 0
            if key in before:
                _, done, mark = before[key]
                # Emptied and filled again: shorter than what was read, or with other bytes there.
                if stat.st_size < done or mark_of(path, done) != mark:
                    done = 0
            elif first and self.from_tail:
                done = last_line_end(path)
            stop = max(done, last_line_end(path, done, self.max_bytes))
            files[key] = [path, stop, mark_of(path, stop)]
            if stop > done:
                reads.append([path, key, done, stop])
        gone = []
        for key, (path, done, _) in before.items():
            if key not in files:
                # Rotated away: what was written before the rename is read to its very end, once.
                renamed = _find(path, key)
                size = os.path.getsize(renamed) if renamed is not None else done
                if renamed is None or size > done:
                    gone.append([path, key, done, size])
        return {"files": files, "reads": gone + reads}

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        plan = self._load(partition.after, partition.shard)
        if plan is None:
            before = self._load(partition.before, partition.shard) if partition.before else None
            if before is None and partition.before:
                raise RuntimeError(f"the ledger has lost shard {partition.shard} of version {partition.before}")
            found = self.plan(partition.shard, (before or {"files": {}})["files"], not partition.before)
            plan = self._store(partition.after, partition.shard, found)
        for path, key, start, stop in plan["reads"]:
            yield from read_range(ByteRange(path, key, start, start, stop, stop))


class LedgerTailSource(DataSource):
    """Format ``podlens_ledger_tail``: ``path`` glob, ``ledger`` folder, ``shards``, ``fromTail``, ``maxBytesPerFile``."""

    @classmethod
    def name(cls) -> str:
        return "podlens_ledger_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 (interface name)
        return LedgerTailReader(self.options)


def stream_tail_ledger(
    spark: SparkSession,
    pattern: str,
    ledger: str,
    shards: int | None = None,
    from_tail: bool = False,
    max_bytes_per_file: int | None = None,
    errors: bool = False,
) -> DataFrame:
    """``(value, path)`` of the lines that appear in the files, as :func:`~podlens.streaming.tail.stream_tail` gives them.

    ``ledger`` is a folder that lasts as long as the checkpoint of the stream. Every micro-batch looks at
    all files, so the trigger is the interval of the polling. ``max_bytes_per_file`` bounds what a batch
    takes from one file. A file is read by one task; one that outgrows that belongs into ``stream_tail``,
    which cuts ranges.
    """
    pickle_by_value()
    spark.dataSource.register(LedgerTailSource)
    reader = spark.readStream.format("podlens_ledger_tail").option("path", pattern)
    reader = reader.option("ledger", ledger.removeprefix("file:")).option("fromTail", str(from_tail).lower())
    reader = reader.option("shards", shards or spark.sparkContext.defaultParallelism)
    if max_bytes_per_file is not None:
        reader = reader.option("maxBytesPerFile", max_bytes_per_file)
    lines = reader.load()
    return lines if errors else lines.where("error is null").drop("error")
