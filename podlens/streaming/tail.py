"""A stream over files that still grow, with rotation by inode and device.

The offset names every file by device and inode. It holds the byte position behind its last complete
line, and the first bytes of the file, by which a file that was emptied and filled again is known.
What can no longer be read becomes a row with an ``error``; the rest of the batch goes on. Executors
must see the files under the same paths as the driver.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from podlens.session import pickle_by_value

SCHEMA = "value string, path string, error string"
ARROW = pa.schema([("value", pa.string()), ("path", pa.string()), ("error", pa.string())])
LINES_PER_BATCH = 10_000
SEARCH_BLOCK = 64 * 1024
HEAD_BYTES = 64


@dataclass(frozen=True)
class Cursor:
    """A stored position: ``inode;device;value``."""

    inode: int
    device: int
    value: int

    def __str__(self) -> str:
        return f"{self.inode};{self.device};{self.value}"


def parse_cursor(text: str) -> Cursor:
    parts = text.split(";")
    if len(parts) != 3 or not all(part.isascii() and part.isdigit() for part in parts):
        raise ValueError(f"no cursor: {text!r}")
    return Cursor(*(int(part) for part in parts))


def last_line_end(path: str, first: int = 0, limit: int | None = None, one: bool = True) -> int:
    """Position behind the last newline from ``first`` on, ``first`` when there is none.

    With a ``limit`` it lies at most that many bytes on; with ``one``, a first line that is longer is
    taken all the same. A file that cannot be read or has become shorter than ``first`` gives 0.
    """
    try:
        with open(path, "rb") as file:
            size = file.seek(0, os.SEEK_END)
            if size < first:
                return 0
            end = size if limit is None else min(size, first + limit)
            while end > first:
                start = max(first, end - SEARCH_BLOCK)
                file.seek(start)
                found = file.read(end - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                end = start
            if one and limit is not None and size > first + limit:
                file.seek(first)
                line = file.readline()
                return first + len(line) if line.endswith(b"\n") else first
            return first
    except OSError:
        return 0


def head_of(path: str, position: int) -> str:
    """The first bytes of a file, as far as they lie before a position."""
    try:
        with open(path, "rb") as file:
            return file.read(min(position, HEAD_BYTES)).hex()
    except OSError:
        return ""


def _key(stat: os.stat_result) -> str:
    return f"{stat.st_dev}:{stat.st_ino}"


def _stat(path: str) -> os.stat_result | None:
    try:
        return os.stat(path)
    except OSError:
        return None


def _find(path: str, key: str) -> str | None:
    """Where the file ``key`` is now: at its path, or renamed within its folder."""
    stat = _stat(path)
    if stat is not None and _key(stat) == key:
        return path
    try:
        with os.scandir(os.path.dirname(path)) as entries:
            for entry in entries:
                if entry.is_file(follow_symlinks=False) and _key(entry.stat(follow_symlinks=False)) == key:
                    return entry.path
    except OSError:
        pass
    return None


class ByteRange(NamedTuple):
    """The lines that start in ``[start, stop)`` of a file; the last may run on to ``limit``.

    ``first`` is where the range of the whole file begins.
    """

    path: str
    key: str
    first: int
    start: int
    stop: int
    limit: int


class Ranges(InputPartition):
    """What one task reads, in this order."""

    def __init__(self, parts: list[ByteRange]) -> None:
        super().__init__(None)
        self.parts = [tuple(part) for part in parts]


def packed(parts: list[ByteRange], chunk_bytes: int) -> list[Ranges]:
    """Small ranges share a task, as long as they have no more bytes than one large range."""
    packs: list[list[ByteRange]] = []
    size = 0
    for part in parts:
        length = part.stop - part.start
        if not packs or size + length > chunk_bytes:
            packs.append([])
            size = 0
        packs[-1].append(part)
        size += length
    return [Ranges(pack) for pack in packs]


def ranges(path: str, key: str, start: int, end: int, chunk_bytes: int) -> list[ByteRange]:
    """Cut a range into parts of at most ``chunk_bytes``, so one hot file feeds many tasks."""
    return [
        ByteRange(path, key, start, at, min(at + chunk_bytes, end), end)
        for at in range(start, end, chunk_bytes)
    ]


def read_range(part: ByteRange) -> Iterator[pa.RecordBatch]:
    actual = _find(part.path, part.key)
    lost = f"bytes {part.start} to {part.stop} were removed before they were read"
    try:
        file = open(actual, "rb") if actual is not None else None
    except OSError:
        file = None
    if file is None:
        yield _lost(part.path, lost)
        return
    values: list[str] = []
    with file:
        position = part.start
        if part.start > part.first:
            # The line that holds the byte before belongs to the part before.
            file.seek(part.start - 1)
            position = part.start - 1 + len(file.readline(part.limit - part.start + 1))
        file.seek(position)
        while position < part.stop:
            line = file.readline(part.limit - position)
            if not line:
                break
            position += len(line)
            line = line.removesuffix(b"\n").removesuffix(b"\r")
            if line:
                values.append(line.decode("utf-8", "replace"))
            if len(values) >= LINES_PER_BATCH:
                yield _batch(values, part.path)
                values = []
    if values:
        yield _batch(values, part.path)


def _batch(values: list[str], path: str) -> pa.RecordBatch:
    n = len(values)
    columns = [pa.array(values, pa.string()), pa.array([path] * n, pa.string()), pa.nulls(n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def _lost(path: str, reason: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"value": [None], "path": [path], "error": [reason]}, schema=ARROW)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.pattern = options["path"]
        self.from_tail = options.get("fromtail", "false").lower() == "true"
        self.chunk_bytes = int(options.get("chunkbytes", 64 * 1024 * 1024))
        self.positions = json.loads(options.get("positions", "{}"))
        self.max_bytes = int(options["maxbytespertrigger"]) if "maxbytespertrigger" in options else None
        # The last offset that this reader knows; it fixes where a file ends that is rotated away.
        self.last: dict[str, list] = {}

    def _files(self) -> dict[str, str]:
        found = {}
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            stat = _stat(path)
            if stat is not None and os.path.isfile(path):
                found.setdefault(_key(stat), path)
        return found

    def _stored(self, path: str, key: str) -> int | None:
        """The stored position, if it was taken on this very file."""
        try:
            cursor = parse_cursor(self.positions[path])
        except (KeyError, ValueError):
            return None
        return cursor.value if f"{cursor.device}:{cursor.inode}" == key else None

    def initialOffset(self) -> dict:  # noqa: N802 (interface name)
        offset = {}
        for key, path in self._files().items():
            position = self._stored(path, key)
            if position is None:
                position = last_line_end(path) if self.from_tail else 0
            offset[key] = [path, position, head_of(path, position), False]
        self.last = offset
        return offset

    def latestOffset(self) -> dict:  # noqa: N802 (interface name)
        offset, left = {}, self.max_bytes
        for key, path in self._files().items():
            done = self._continued(key, path)
            stop = last_line_end(path, done, left, one=left == self.max_bytes)
            if left is not None:
                left = max(0, left - max(0, stop - done))
            offset[key] = [path, stop, head_of(path, stop), False]
        for key, (path, done, _, gone) in self.last.items():
            if key not in offset and not gone:
                # Rotated away: what was written before the rename is read to its very end, once.
                renamed = _find(path, key)
                size = os.path.getsize(renamed) if renamed is not None else -1
                offset[key] = [path, size, "", True]
        self.last = offset
        return offset

    def _continued(self, key: str, path: str) -> int:
        """Where the reading of a file goes on: at its start if its first bytes are others than before."""
        if key not in self.last:
            return 0
        _, done, head, _ = self.last[key]
        return done if head_of(path, done).startswith(head) else 0

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        parts: list[ByteRange] = []
        gone = {key: stop for key, (_, stop, _, rotated) in end.items() if rotated}
        for key, (path, done, _, rotated) in start.items():
            if rotated or (key in end and key not in gone):
                continue
            stop = gone.get(key, -1)
            if key not in gone:
                # The reader was started anew in between, so the end was not fixed.
                renamed = _find(path, key)
                stop = os.path.getsize(renamed) if renamed is not None else -1
            # Without an end the file is lost: a range that cannot be found becomes an error.
            found = ranges(path, key, done, stop, self.chunk_bytes)
            parts += found if stop >= 0 else [ByteRange(path, key, done, done, done, done)]
        for key, (path, stop, head, rotated) in end.items():
            if rotated:
                continue
            _, done, before, _ = start.get(key, [path, 0, "", False])
            # A file that became shorter, or begins with other bytes, was emptied and holds new lines.
            same = done <= stop and head.startswith(before)
            parts += ranges(path, key, done if same else 0, stop, self.chunk_bytes)
        self.last = self.last or end
        return packed(parts, self.chunk_bytes)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from read_range(ByteRange(*part))


class TailSource(DataSource):
    """Format ``podlens_tail``: ``path`` glob, ``fromTail``, ``chunkBytes``, ``positions``, ``maxBytesPerTrigger``."""

    @classmethod
    def name(cls) -> str:
        return "podlens_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 (interface name)
        return TailReader(self.options)


def stream_tail(
    spark: SparkSession,
    pattern: str,
    from_tail: bool = False,
    positions: dict[str, str] | None = None,
    chunk_bytes: int = 64 * 1024 * 1024,
    max_bytes_per_trigger: int | None = None,
    errors: bool = False,
) -> DataFrame:
    """``(value, path)`` of the lines that appear in the files.

    With ``errors`` there is a third column, and a row for every file that went before all of it was
    read; without, those rows are left out. ``max_bytes_per_trigger`` bounds a micro-batch, also the
    first one.

    ``positions`` maps paths to stored cursors for the first run; one counts only while inode and
    device match, and then wins over ``from_tail``. Later runs resume from the checkpoint.
    """
    pickle_by_value()
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("podlens_tail").option("path", pattern)
    reader = reader.option("fromTail", str(from_tail).lower()).option("chunkBytes", chunk_bytes)
    if positions:
        reader = reader.option("positions", json.dumps(positions))
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    lines = reader.load()
    return lines if errors else lines.where("error is null").drop("error")
