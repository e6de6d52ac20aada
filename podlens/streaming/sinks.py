"""Delivery of JSON lines: the sink contract, batching with retry, and the sink data source.

A sink is built on the executor by a factory without arguments. Every chunk of messages carries a
key. A repeated task sends the same keys again; a repeated micro-batch may be dealt into other
partitions, so after all its tasks the sink is told which keys count, and makes just those visible.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceStreamWriter,
    DataSourceWriter,
    WriterCommitMessage,
)

from podlens.options import DeliveryOptions
from podlens.session import pickle_by_value, scratch_dir, small_side


class DeliveryKey(NamedTuple):
    """Names one chunk of messages: job, micro-batch, partition and number within it.

    The job must differ between any two writers of one target: runs, streams and checkpoints. Two
    attempts of one task send the same chunks under different ``attempt`` names.
    """

    job: str
    batch: int
    partition: int
    chunk: int
    attempt: str = ""


class Sent(NamedTuple):
    """How many chunks of a partition count, and which attempt of its task sent them."""

    chunks: int
    attempt: str = ""


class Sink(Protocol):
    """Where messages go. A sink that could send only a part must raise and see the chunk again.

    A sink that holds chunks back has a ``flush`` without arguments, which is called after the last chunk of a
    task and, when it raises, tried again like a chunk.
    """

    def deliver(self, messages: list[str], key: DeliveryKey) -> None: ...

    def finish(self, job: str, batch: int, sent: dict[int, Sent]) -> None:
        """Called on the driver once all tasks of a batch are done, with what counts of each partition.

        Until then nothing of the batch should be visible to readers; afterwards exactly this should be.
        """

    def close(self) -> None: ...


def chunked(messages: Iterable[str], size: int) -> Iterator[list[str]]:
    buffer: list[str] = []
    for message in messages:
        buffer.append(message)
        if len(buffer) >= size:
            yield buffer
            buffer = []
    if buffer:
        yield buffer


def _retried(call: Callable[[], None], options: DeliveryOptions) -> None:
    for attempt in range(1, options.max_attempts + 1):
        try:
            return call()
        except Exception:
            if attempt == options.max_attempts:
                raise
            time.sleep(options.retry_seconds)


def send(
    open_sink: Callable[[], Sink],
    messages: Iterable[str],
    job: str,
    batch: int,
    partition: int,
    options: DeliveryOptions,
    attempt_id: str = "",
) -> tuple[int, int]:
    """Send one partition in chunks; a failed chunk is kept and tried again before the task fails.

    Returns the numbers of messages and of chunks.
    """
    sink = open_sink()
    sent = chunks = 0
    try:
        for chunk, part in enumerate(chunked(messages, options.batch_size)):
            key = DeliveryKey(job, batch, partition, chunk, attempt_id)
            _retried(partial(sink.deliver, part, key), options)
            sent, chunks = sent + len(part), chunk + 1
        if hasattr(sink, "flush"):
            _retried(sink.flush, options)
    finally:
        sink.close()
    return sent, chunks


def finish(open_sink: Callable[[], Sink], job: str, batch: int, sent: dict[int, Sent]) -> None:
    sink = open_sink()
    try:
        sink.finish(job, batch, sent)
    finally:
        sink.close()


def deliver_batches(
    messages: DataFrame,
    open_sink: Callable[[], Sink],
    job: str,
    options: DeliveryOptions = DeliveryOptions(),
    batch: int = 0,
) -> int:
    """Send the ``value`` column from the executors; returns how many messages were sent.

    ``job`` names this run: two runs with one name and one target replace each other's messages.
    """
    if not job:
        raise ValueError("a delivery needs the name of its job")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (value for b in batches for value in b.column(0).to_pylist())
        partition = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex
        sent, chunks = send(open_sink, texts, job, batch, partition, options, attempt)
        row = {"partition": [partition], "chunks": [chunks], "sent": [sent], "attempt": [attempt]}
        yield pa.RecordBatch.from_pydict(row)

    # One row for each partition.
    schema = "partition long, chunks long, sent long, attempt string"
    rows = messages.select("value").mapInArrow(run, schema).collect()
    finish(open_sink, job, batch, {row["partition"]: Sent(row["chunks"], row["attempt"]) for row in rows})
    return sum(row["sent"] for row in rows)


class FileSink:
    """Writes the chunks of a task to files of its own and publishes a batch by a manifest that names its files.

    The manifest is put in place by one rename, so a reader of :func:`published_messages` sees all of a
    batch or nothing, and of a repeated batch the old messages or the new ones. Chunks lie in
    ``chunks/job=/batch=``, manifests in ``published/job=``; the manifest of a batch is replaced when the batch is
    repeated, and files that no longer count are removed. The folder may be a path or a URI of any file
    system that Arrow knows and that renames files at once.

    Chunks are held until they fill a file of ``file_bytes`` or the sink is closed or finishes, so that files grow
    in number with the bytes sent and not with the chunks. Files are named
    ``<partition>-<first chunk>-<last chunk>-<attempt>``.
    """

    def __init__(self, folder: str, file_bytes: int = 16 << 20) -> None:
        self._files, self._folder = fs.FileSystem.from_uri(folder)
        self._files.create_dir(self._folder, recursive=True)
        self._file_bytes = file_bytes
        self._held: dict[tuple[str, int, int, str], dict[int, bytes]] = {}

    def _place(self, job: str, batch: int) -> str:
        return f"{self._folder}/chunks/job={job}/batch={batch}"

    def _put(self, place: str, name: str, content: bytes) -> None:
        self._files.create_dir(place, recursive=True)
        temporary = f"{place}/.{name}.{uuid.uuid4().hex}"
        with self._files.open_output_stream(temporary) as file:
            file.write(content)
        self._files.move(temporary, f"{place}/{name}")

    def deliver(self, messages: list[str], key: DeliveryKey) -> None:
        task = (key.job, key.batch, key.partition, key.attempt)
        held = self._held.setdefault(task, {})
        # A chunk that is tried again replaces itself.
        held[key.chunk] = "".join(f"{message}\n" for message in messages).encode()
        if sum(map(len, held.values())) >= self._file_bytes:
            self._write(task)

    def _write(self, task: tuple[str, int, int, str]) -> None:
        """Put what is held of a task in its file; if that fails, it is still held."""
        job, batch, partition, attempt = task
        held = self._held[task]
        self._put(self._place(job, batch), f"{partition}-{min(held)}-{max(held)}-{attempt}.txt", b"".join(held[i] for i in sorted(held)))
        del self._held[task]

    def finish(self, job: str, batch: int, sent: dict[int, Sent]) -> None:
        self.flush()
        place, names, missing = self._place(job, batch), set(), sum(one.chunks for one in sent.values())
        for file in self._files.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            partition, first, last, attempt = (file.base_name.removesuffix(".txt").split("-", 3) + [""] * 3)[:4]
            one = sent.get(int(partition)) if partition.isdecimal() else None
            if one is not None and attempt == one.attempt and int(last) < one.chunks:
                names.add(file.base_name)
                missing -= int(last) - int(first) + 1
        if missing:
            raise FileNotFoundError(f"{missing} chunks of {job}, batch {batch}, are not in {place}")
        rows = "".join(json.dumps({"job": job, "batch": batch, "file": f"job={job}/batch={batch}/{name}"}) + "\n" for name in sorted(names))
        self._put(f"{self._folder}/published/job={job}", f"{batch}.json", rows.encode())
        for file in self._files.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            if file.base_name not in names:
                self._files.delete_file(file.path)

    def flush(self) -> None:
        for task in list(self._held):
            self._write(task)

    def close(self) -> None:
        """Write what is still held."""
        self.flush()


def published_messages(spark: SparkSession, folder: str) -> DataFrame:
    """``(job, batch, value)`` of the messages in the published batches of a :class:`FileSink`.

    The manifests are read first and stored; of the files listed after that only those they name are read.
    """
    root = folder.rstrip("/")
    nothing = spark.createDataFrame([], "job string, batch long, value string")
    try:
        manifests = spark.read.schema("file string").json(f"{root}/published/*/*.json")
    except AnalysisException:
        return nothing  # no batch yet
    stored = scratch_dir(spark, "manifests")
    manifests.write.parquet(stored)
    named = small_side(spark.read.schema("file string").parquet(stored))
    rows = spark.read.schema("value string, job string, batch long").text(f"{root}/chunks")
    place = F.concat_ws("/", *[F.element_at(F.split(F.col("_metadata.file_path"), "/"), -i) for i in (3, 2, 1)])
    return rows.select("job", "batch", "value", place.alias("file")).join(named, "file", "left_semi").drop("file")


class _Sent(WriterCommitMessage):
    def __init__(self, job: str, batch: int, partition: int, sent: Sent) -> None:
        self.job, self.batch, self.partition, self.sent = job, batch, partition, sent


class _SinkWriter(DataSourceWriter, DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.factory = options["sink"]
        self.target = options.get("target")
        self.job = options.get("job", "")
        self.delivery = DeliveryOptions(
            batch_size=int(options.get("batchsize", DeliveryOptions.batch_size)),
            retry_seconds=float(options.get("retryseconds", DeliveryOptions.retry_seconds)),
            max_attempts=int(options.get("maxattempts", DeliveryOptions.max_attempts)),
        )

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        context = TaskContext.get()
        # The streaming engine names the micro-batch of a task in its local properties.
        batch = int(context.getLocalProperty("streaming.sql.batchId") or 0)
        # A new checkpoint makes a new query id, so its batches do not meet those of an old one.
        job = "-".join(filter(None, [self.job, context.getLocalProperty("sql.streaming.queryId")]))
        if not job:
            raise ValueError("option job is needed: the name of this run")
        texts = (row["value"] for row in iterator)
        partition = context.partitionId()
        attempt = uuid.uuid4().hex
        _, chunks = send(self.open_sink, texts, job, batch, partition, self.delivery, attempt)
        return _Sent(job, batch, partition, Sent(chunks, attempt))

    def open_sink(self) -> Sink:
        module, _, name = self.factory.partition(":")
        factory = getattr(importlib.import_module(module), name)
        return factory(self.target) if self.target else factory()

    def commit(self, messages, batchId=None) -> None:  # noqa: N803 (interface name)
        """All tasks are done: the sink drops what earlier attempts of the batch left."""
        done = [message for message in messages if message is not None]
        if done:
            sent = {message.partition: message.sent for message in done}
            finish(self.open_sink, done[0].job, done[0].batch, sent)

    def abort(self, messages, batchId=None) -> None:  # noqa: N803 (interface name)
        """Sent chunks stay until the batch is repeated and finished."""


class SinkSource(DataSource):
    """Format ``podlens_sink`` for rows with a ``value``.

    Option ``sink`` is ``module:factory``; the factory gets the option ``target`` if there is one.
    Option ``job`` names the run; a stream adds the id of its query, a batch write needs the option.
    """

    @classmethod
    def name(cls) -> str:
        return "podlens_sink"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _SinkWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _SinkWriter(self.options)


def register_sink(spark: SparkSession) -> None:
    pickle_by_value()
    spark.dataSource.register(SinkSource)


def write_lines(messages: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines as text files."""
    messages.select("value").write.mode("append").option("compression", compression).text(path)


def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """JSON lines to a Kafka topic; needs the Kafka connector on the class path."""
    writer = messages.select("value").write.format("kafka")
    writer.option("kafka.bootstrap.servers", servers).option("topic", topic).save()
