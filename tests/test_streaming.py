import os
import random
import uuid
from datetime import datetime, timezone
from functools import partial

import pytest
from pyspark.sql import functions as F

from podlens import names
from podlens.operators.rates import throttle_delay
from podlens.options import DeliveryOptions, MetricOptions, ParseOptions, RateOptions
from podlens.plans import workload
from podlens.sources.containers import container_catalog_cri
from podlens.sources.lines import scan_partitioned_lines, scan_pod_lines, stream_log_lines
from podlens.streaming.history import CatalogHistory, RefreshingHistory, as_of
from podlens.streaming.inventory import LiveInventory, inventory_step
from podlens.streaming.live import LiveOptions, LiveSamples
from podlens.streaming.jobs import emit_to_sink, stream_records
from podlens.streaming.refresh import RefreshingTable, RefreshingValue
from podlens.streaming.sinks import (
    DeliveryKey,
    FileSink,
    Sent,
    chunked,
    deliver_batches,
    published_messages,
    register_sink,
    send,
)
from podlens.streaming.tail import Cursor, TailReader, last_line_end, parse_cursor, stream_tail


def test_cursor():
    assert parse_cursor("0;1;2") == Cursor(0, 1, 2)
    assert str(Cursor(0, 1, 2)) == "0;1;2"
    for text in ("-1;1;1", "1;-1;1", "1;1;-1", "1;1", "a;1;1", "1;a;1", "1;1;a", "", "1;1;1;1"):
        with pytest.raises(ValueError):
            parse_cursor(text)


@pytest.mark.parametrize(
    "content, position",
    [("value1\nvalue2", 7), ("value1value2", 0), ("value1v\n\na\nlue2", 11), ("\n", 1), ("", 0), ("x\n" + "y" * 200_000, 2)],
)
def test_last_line_end(tmp_path, content, position):
    (tmp_path / "f").write_text(content)
    assert last_line_end(str(tmp_path / "f")) == position
    assert last_line_end(str(tmp_path / "missing")) == 0


def reader(tmp_path, **options):
    return TailReader({"path": str(tmp_path / "*.log"), **options})


def lines_between(r, start, end):
    return [row["value"] for row in rows_between(r, start, end) if row["error"] is None]


def rows_between(r, start, end):
    return [row for part in r.partitions(start, end) for batch in r.read(part) for row in batch.to_pylist()]


def test_tail_appends(tmp_path):
    file = tmp_path / "a.log"
    file.write_text("value1\nvalue2")
    r = reader(tmp_path)
    start = r.initialOffset()
    first = r.latestOffset()
    # The unfinished line is held back until it ends, so it is never torn.
    assert lines_between(r, start, first) == ["value1"]
    with file.open("a") as f:
        f.write("value3\r\n\nvalue4")
    second = r.latestOffset()
    assert lines_between(r, first, second) == ["value2value3"]
    assert lines_between(r, second, r.latestOffset()) == []
    # A repeated batch gives the same lines.
    assert lines_between(r, first, second) == ["value2value3"]


def test_tail_rotation(tmp_path):
    file = tmp_path / "a.log"
    file.write_text("value1\n")
    r = reader(tmp_path)
    first = r.latestOffset()
    with file.open("a") as f:
        f.write("more\nvalue2")
    file.rename(tmp_path / "a.log.0")
    (tmp_path / "a.log").write_text("value3\nvalue4\n")
    second = r.latestOffset()
    # The renamed file is read to its end before the new one.
    assert lines_between(r, first, second) == ["more", "value2", "value3", "value4"]
    (tmp_path / "a.log").unlink()
    third = r.latestOffset()
    assert lines_between(r, second, third) == []
    assert r.latestOffset() == {}
    # A repeated batch ends where it ended, whatever is written to the renamed file meanwhile.
    with (tmp_path / "a.log.0").open("a") as f:
        f.write("late\n")
    assert lines_between(r, first, second)[:2] == ["more", "value2"]


def test_tail_file_removed_before_the_next_offset(tmp_path):
    (tmp_path / "a.log").write_text("value1\n")
    (tmp_path / "b.log").write_text("other1\n")
    r = reader(tmp_path)
    first = r.initialOffset()
    (tmp_path / "a.log").unlink()
    (tmp_path / "b.log").write_text("other1\nother2\n")
    rows = rows_between(r, first, r.latestOffset())
    assert [row["value"] for row in rows if row["error"] is None] == ["other1", "other2"]
    assert [row["path"] for row in rows if row["error"]] == [str(tmp_path / "a.log")]


def test_tail_file_removed_before_it_is_read(tmp_path):
    (tmp_path / "a.log").write_text("value1\nvalue2\n")
    (tmp_path / "b.log").write_text("other\n")
    r = reader(tmp_path)
    start, end = r.initialOffset(), r.latestOffset()
    (tmp_path / "a.log").unlink()
    # Each time the batch is repeated the other files are read, and what is lost is named.
    for _ in range(2):
        rows = rows_between(r, start, end)
        assert [row["value"] for row in rows if row["error"] is None] == ["other"]
        assert ["bytes 0 to 14" in row["error"] for row in rows if row["error"]] == [True]


def test_tail_file_emptied_and_filled_beyond_its_position(tmp_path):
    file = tmp_path / "a.log"
    file.write_text("old1\nold2\n")
    r = reader(tmp_path)
    start, first = r.initialOffset(), r.latestOffset()
    assert lines_between(r, start, first) == ["old1", "old2"]
    file.write_text("new1\nnew2\nnew3\nnew4\n")
    second = r.latestOffset()
    assert lines_between(r, first, second) == ["new1", "new2", "new3", "new4"]
    assert lines_between(reader(tmp_path), first, second) == ["new1", "new2", "new3", "new4"]


def test_tail_bytes_of_a_batch_are_bounded(tmp_path):
    lines = [f"line number {i}" for i in range(50)]
    (tmp_path / "a.log").write_text("".join(f"{line}\n" for line in lines[:30]))
    (tmp_path / "b.log").write_text("".join(f"{line}\n" for line in lines[30:]) + "x" * 500 + "\n")
    r = reader(tmp_path, maxbytespertrigger="100")
    at, found, batches = r.initialOffset(), [], 0
    while True:
        following = r.latestOffset()
        new = lines_between(r, at, following)
        if not new:
            break
        assert sum(len(line) + 1 for line in new) <= 100 or new == ["x" * 500]
        found, at, batches = found + new, following, batches + 1
    assert found == [*lines, "x" * 500] and batches > 7


def test_tail_start_positions(tmp_path):
    file = tmp_path / "a.log"
    file.write_text("value1\nvalue2")
    stat = os.stat(file)

    def start(**options):
        return [entry[1] for entry in reader(tmp_path, **options).initialOffset().values()]

    def stored(inode):
        return '{"%s": "%d;%d;2"}' % (file, inode, stat.st_dev)

    assert start() == [0]
    assert start(fromtail="true") == [7]
    assert start(fromtail="true", positions=stored(stat.st_ino)) == [2]
    assert start(fromtail="true", positions=stored(stat.st_ino + 1)) == [7]
    assert start(positions=stored(stat.st_ino + 1)) == [0]


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 7, 64])
def test_tail_chunks_give_every_line_once(tmp_path, chunk):
    lines = ["", "a", "bc", "long line", "", "é", "x" * 30]
    (tmp_path / "a.log").write_text("".join(f"{line}\n" for line in lines))
    r = reader(tmp_path, chunkbytes=str(chunk))
    assert lines_between(r, r.initialOffset(), r.latestOffset()) == [line for line in lines if line]


def test_small_files_share_a_task(tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.log").write_text("line\n" * 4)
    r = reader(tmp_path, chunkbytes="100")
    parts = r.partitions(r.initialOffset(), r.latestOffset())
    assert [len(p.parts) for p in parts] == [5, 5]
    assert len(lines_between(r, r.initialOffset(), r.latestOffset())) == 40


def run(writer, checkpoint):
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_tail_stream_resumes(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (logs / "a.log").write_text("one\ntwo\nthr")

    def once():
        stream = stream_tail(spark, f"{logs}/*.log")
        run(stream.writeStream.format("parquet").option("path", out), checkpoint)
        return sorted(r.value for r in spark.read.parquet(out).collect())

    assert once() == ["one", "two"]
    assert once() == ["one", "two"]
    with (logs / "a.log").open("a") as f:
        f.write("ee\nfour\n")
    assert once() == ["four", "one", "three", "two"]


class Recorder:
    def __init__(self, failures=0):
        self.failures, self.calls, self.closed = failures, [], False

    def deliver(self, messages, key):
        self.calls.append((list(messages), key))
        if len(self.calls) <= self.failures:
            raise ConnectionError

    def finish(self, job, batch, chunks):
        self.finished = (job, batch, chunks)

    def close(self):
        self.closed = True


def test_batches_and_retries():
    assert list(chunked("abcde", 2)) == [["a", "b"], ["c", "d"], ["e"]]
    sink = Recorder(failures=2)
    options = DeliveryOptions(batch_size=2, retry_seconds=0, max_attempts=3)
    assert send(lambda: sink, ["a", "b", "c"], "job", 4, 1, options) == (3, 2)
    key = DeliveryKey("job", 4, 1, 0)
    assert sink.calls == [(["a", "b"], key)] * 3 + [(["c"], key._replace(chunk=1))]
    assert sink.closed
    failing = Recorder(failures=9)
    with pytest.raises(ConnectionError):
        send(lambda: failing, ["a"], "job", 0, 0, options)
    assert len(failing.calls) == 3 and failing.closed


def sink_lines(folder):
    files = [os.path.join(at, name) for at, _, names in os.walk(folder) for name in names if name.endswith(".txt")]
    return sorted(line for file in files for line in open(file).read().split("\n") if line)


def test_deliver_and_repeat(spark, tmp_path):
    messages = spark.range(1000).selectExpr("cast(id as string) value").repartition(3, "value")
    expected = sorted(str(i) for i in range(1000))
    open_sink, options = partial(FileSink, str(tmp_path)), DeliveryOptions(batch_size=64)
    for dealt in (messages, messages, messages.repartition(2), messages.repartition(7), messages.coalesce(1)):
        assert deliver_batches(dealt, open_sink, "j", options, 7) == 1000
        # A repeated batch replaces itself, also if its messages are dealt into other partitions.
        assert sink_lines(tmp_path) == expected
    deliver_batches(messages, open_sink, "j", options, 8)
    deliver_batches(messages, open_sink, "k", options, 7)
    assert sink_lines(tmp_path) == sorted(expected * 3)
    with pytest.raises(ValueError, match="name of its job"):
        deliver_batches(messages, open_sink, "", options)


def test_two_streams_and_a_new_checkpoint_share_a_target(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("x\ny\n")
    register_sink(spark)
    for name in "abc":
        stream = spark.readStream.text(str(source)).writeStream.format("podlens_sink")
        stream = stream.option("sink", "podlens.streaming.sinks:FileSink").option("target", str(target))
        run(stream, str(tmp_path / f"checkpoint-{name}"))
    assert sink_lines(target) == ["x"] * 3 + ["y"] * 3


def test_batch_write_needs_a_job(spark, tmp_path):
    register_sink(spark)
    writer = spark.createDataFrame([("x",)], "value string").write.format("podlens_sink").mode("append")
    writer = writer.option("sink", "podlens.streaming.sinks:FileSink").option("target", str(tmp_path))
    with pytest.raises(Exception, match="option job is needed"):
        writer.save()
    for job in ("one", "two"):
        writer.option("job", job).save()
    assert sink_lines(tmp_path) == ["x", "x"]


def test_sink_format_in_a_stream(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("x\ny\n")
    register_sink(spark)
    stream = spark.readStream.text(str(source)).writeStream.format("podlens_sink")
    stream = stream.option("sink", "podlens.streaming.sinks:FileSink").option("target", str(target))
    run(stream, str(tmp_path / "checkpoint"))
    assert sink_lines(target) == ["x", "y"]


def test_stream_of_records_resumes(spark, tmp_path):
    folder = tmp_path / "pods" / "ns_pod_id" / "app"
    folder.mkdir(parents=True)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    seen = []

    def once():
        lines = stream_log_lines(spark, f"{tmp_path}/pods")
        catalog = RefreshingTable(
            spark, lambda: container_catalog_cri(spark.createDataFrame([(f"{folder}/0.log",), (f"{folder}/1.log",)], "path string")), 10
        )
        emit = emit_to_sink(partial(FileSink, out), job=uuid.uuid4().hex)
        run(stream_records(lines, catalog.current, emit, metrics=lambda df, i: seen.append(df.count())), checkpoint)

    (folder / "0.log").write_text('T stdout F {"a":1}\nT stdout F {"logging":false}\nplain\n')
    once()
    assert len(sink_lines(out)) == 2 and seen == [3]
    assert all('"kubernetes.pod_name":"pod"' in line for line in sink_lines(out))
    (folder / "1.log").write_text("T stdout F x\n")
    once()
    assert len(sink_lines(out)) == 3 and seen == [3, 1]


def test_refreshing(spark):
    now, loads = [0.0], []

    def load():
        loads.append(now[0])
        if len(loads) == 2:
            raise RuntimeError
        return spark.range(len(loads))

    table = RefreshingTable(spark, load, 10, clock=lambda: now[0])
    assert table.current().count() == 1
    now[0] = 9
    assert table.current().count() == 1 and loads == [0]
    now[0] = 10
    # The failed load leaves the old snapshot, until the next interval.
    assert table.current().count() == 1 and isinstance(table.last_error, RuntimeError)
    now[0] = 20
    assert table.current().count() == 3 and loads == [0, 10, 20]

    value = RefreshingValue(lambda: [], lambda old, new: new or old, ["old"], 10, clock=lambda: now[0])
    assert value.current() == ["old"]


def test_workload_lines_all_come_back(spark):
    lines = workload.log_lines(spark, "/root/testdata/sf0.001")
    kept = workload.read_lines(spark, "/root/testdata/sf0.001")
    assert kept.count() == lines.where(F.length("value") > 0).count() < lines.count()


def test_history_of_a_catalog(spark, tmp_path):
    def at(second):
        return datetime.fromtimestamp(second, timezone.utc)

    def snapshot(**services):
        return spark.createDataFrame(list(services.items()), "host string, service string")

    history = CatalogHistory(spark, str(tmp_path / "history"))
    assert history.empty
    assert history.record(snapshot(a="one", b="two"), at(100))
    assert not history.record(snapshot(a="one", b="two"), at(150))
    assert history.record(snapshot(a="other", c="three"), at(200))
    # Another job with the same folder goes on where this one stopped.
    history = CatalogHistory(spark, str(tmp_path / "history"))
    assert history.record(snapshot(a="one", b="two", c="three"), at(300))
    # A change at the same time replaces what began then.
    assert history.record(snapshot(a="late", b="two", c="three"), at(300))
    rows = history.table().select("host", "service", F.unix_seconds("valid_from"), F.unix_seconds("valid_to")).collect()
    expected = [
        ("a", "late", 300, None),
        ("a", "one", None, 200),
        ("a", "other", 200, 300),
        ("b", "two", 300, None),
        ("b", "two", None, 200),
        ("c", "three", 200, None),
    ]
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
    with pytest.raises(ValueError, match="lies before"):
        history.record(snapshot(), at(299))
    moments = [0, 199, 200, 299, 300, 1000, None]
    events = [(host, None if m is None else at(m)) for host in "abcd" for m in moments]
    found = as_of(spark.createDataFrame(events, "host string, event_time timestamp"), history.table())
    got = {(r.host, None if r.event_time is None else int(r.event_time.replace(tzinfo=timezone.utc).timestamp())): r.service for r in found.collect()}

    def truth(host, moment):
        for h, service, first, last in expected:
            open_ = moment is None and last is None
            if h == host and (open_ or (moment is not None and (first is None or moment >= first) and (last is None or moment < last))):
                return service

    assert got == {(h, m): truth(h, m) for h in "abcd" for m in moments if truth(h, m)}
    history.forget(at(250))
    assert history.table().count() == 4


def test_history_keeps_the_old_catalog_when_loading_fails(spark, tmp_path):
    now, loads = [0.0], [spark.createDataFrame([("a", "one")], "host string, service string")]

    def load():
        if not loads:
            raise RuntimeError("not available")
        return loads.pop()

    current = RefreshingHistory(CatalogHistory(spark, str(tmp_path / "h")), load, 60, lambda: now[0])
    assert current.current().count() == 1
    now[0] = 30
    assert current.current().count() == 1 and current.last_error is None
    now[0] = 60
    assert current.current().count() == 1 and isinstance(current.last_error, RuntimeError)
    with pytest.raises(RuntimeError):
        RefreshingHistory(CatalogHistory(spark, str(tmp_path / "new")), load, 60, lambda: now[0]).current()


def bucket_delays(reads, rate, carried=None):
    """The token bucket one read after the other: how long each waits, and when the bucket is full again."""
    busy, out = carried, []
    for arrival, n in reads:
        wait = 0.0
        for _ in range(n):
            busy = max(arrival, busy if busy is not None else arrival) + 1 / rate
            wait += max(0.0, busy - int(rate) / rate - arrival)
        out.append(wait)
    return out, busy


def test_throttling_in_parts_equals_the_whole(spark):
    rng = random.Random(3)
    rate = 3.5
    arrivals, at = [], 0.0
    for _ in range(200):
        at += rng.choice([0, 0, 0.01, 0.1, 1.5])
        arrivals.append((at, rng.choice([1, 1, 1, 2, 9])))
    expected, busy = bucket_delays(arrivals, rate)
    rows = [("f", i, a, n, rate) for i, (a, n) in enumerate(arrivals)]
    lines = spark.createDataFrame(rows, "path string, seq long, arrival double, reads long, rate double")
    whole = {r.seq: r.delay for r in throttle_delay(lines, slice_width=17).collect()}
    assert [whole[i] for i in range(200)] == pytest.approx(expected, abs=1e-9)
    got, state = {}, spark.createDataFrame([], "path string, busy_until double")
    for first in (0, 60, 61, 130):
        last = {0: 60, 60: 61, 61: 130, 130: 200}[first]
        part = throttle_delay(lines.where(F.col("seq").between(first, last - 1)), slice_width=17, carried=state)
        part = part.collect()
        got |= {r.seq: r.delay for r in part}
        state = spark.createDataFrame([("f", max(r.busy_until for r in part))], "path string, busy_until double")
    assert [got[i] for i in range(200)] == pytest.approx(expected, abs=1e-9)
    assert state.first().busy_until == pytest.approx(busy)


def test_live_series_end_with_their_container_and_batches_may_be_repeated(spark, tmp_path):
    catalog = spark.createDataFrame(
        [(f"/p{i}", "containerd", f"i{i}", "n", f"p{i}", "c", True) for i in range(2)],
        "path string, type string, id string, namespace string, pod string, container string, running boolean",
    )
    running = [catalog]
    hosts = spark.createDataFrame(
        [("h", "s", [("all", ["."])], None, None)],
        "host string, service string, paths array<struct<label string, regexps array<string>>>, valid_from timestamp, valid_to timestamp",
    )
    options = LiveOptions(metrics=MetricOptions(sum_scale=3), rates=RateOptions(1.0), parse=ParseOptions(max_line_bytes=20))
    live = LiveSamples(spark, str(tmp_path / "live"), lambda: running[0], lambda: hosts, options=options)

    def batch(*lines):
        return spark.createDataFrame([(p, s, a, "T stdout F " + "x" * n) for p, s, a, n in lines], "path string, seq long, arrival double, value string")

    live.update(batch(("/p0", 1, 0.0, 5), ("/p0", 2, 0.0, 5), ("/p1", 1, 0.0, 40)), 0)

    def state(number):
        return {r.pod: r.value for r in live.throttling(number).collect()}

    def messages(number):
        return {r.pod: r.value for r in live.totals(number).where("metric = 'log_message_count'").collect()}

    # A line of 51 bytes is read in three pieces, so it takes three tokens.
    assert state(0) == {"p0": 1.0, "p1": 3.0} and messages(0) == {"p0": 2.0, "p1": 3.0}
    for _ in range(2):
        live.update(batch(("/p0", 3, 0.0, 5), ("/unknown", 1, 0.0, 5)), 1)
        assert state(1) == {"p0": 3.0, "p1": 3.0} and messages(1) == {"p0": 3.0, "p1": 3.0, None: 1.0}
    running[0] = catalog.where("pod = 'p1'")
    live.update(batch(("/p1", 2, 100.0, 5)), 2)
    assert state(2) == {"p1": 3.0}
    # Back again, it begins at nothing.
    running[0] = catalog
    live.update(batch(("/p0", 4, 0.0, 5), ("/p0", 5, 0.0, 5)), 3)
    assert state(3) == {"p0": 1.0, "p1": 3.0}


def published(spark, folder):
    return sorted(row.value for row in published_messages(spark, str(folder)).collect())


def test_readers_see_whole_batches_only(spark, tmp_path):
    messages = spark.range(300).selectExpr("cast(id as string) value").repartition(3, "value")
    expected = sorted(str(i) for i in range(300))

    class Broken(FileSink):
        """Sends its chunks, and fails before the batch is published."""

        def finish(self, job, batch, sent):
            raise ConnectionError("the job broke off")

    good, options = partial(FileSink, str(tmp_path)), DeliveryOptions(batch_size=20)
    broken = partial(Broken, str(tmp_path))
    assert published(spark, tmp_path) == []
    with pytest.raises(ConnectionError):
        deliver_batches(messages, broken, "j", options, 0)
    # All chunks were sent, but nothing is published.
    assert len(sink_lines(tmp_path)) == 300 and published(spark, tmp_path) == []
    deliver_batches(messages.repartition(2), good, "j", options, 0)
    assert published(spark, tmp_path) == expected and sink_lines(tmp_path) == expected
    # While a repeated batch is sent anew, readers go on seeing the one that was published.
    with pytest.raises(ConnectionError):
        deliver_batches(messages.repartition(5), broken, "j", options, 0)
    assert len(sink_lines(tmp_path)) == 600 and published(spark, tmp_path) == expected
    deliver_batches(messages, good, "j", options, 0)
    deliver_batches(messages.limit(0), good, "j", options, 1)
    deliver_batches(messages, good, "k", options, 0)
    assert published(spark, tmp_path) == sorted(expected * 2)
    rows = published_messages(spark, str(tmp_path)).groupBy("job", "batch").count().collect()
    assert sorted(map(tuple, rows)) == [("j", 0, 300), ("k", 0, 300)]


def test_two_attempts_of_a_task_do_not_mix(tmp_path):
    sink = FileSink(str(tmp_path))
    for attempt, texts in (("slow", ["a", "b", "c"]), ("fast", ["c", "a"])):
        for i, text in enumerate(texts):
            sink.deliver([text], DeliveryKey("j", 0, 0, i, attempt))
    sink.deliver(["late"], DeliveryKey("j", 0, 0, 0, "slow"))
    sink.finish("j", 0, {0: Sent(2, "fast")})
    assert sink_lines(tmp_path) == ["a", "c"]


def test_inventory_over_snapshots(spark, tmp_path):
    inventory = LiveInventory(spark, str(tmp_path / "inventory"))

    def observe(turn, **running):
        rows = [(name, flag) for name, flag in running.items()]
        found = inventory.observe(spark.createDataFrame(rows, "path string, running boolean"), turn)
        return sorted(map(tuple, found.collect()))

    assert observe(0, a=True, b=True, c=False) == [("a", "started"), ("b", "started"), ("c", "started")]
    for _ in range(2):
        # A repeated snapshot gives the same changes.
        assert observe(1, a=True, b=False, c=False) == [("b", "finished"), ("c", "finished")]
    # What is ignored is not started again while it is there.
    assert observe(2, a=True, b=True) == [("c", "orphaned"), ("c", "unignored")]
    assert observe(3, b=False, c=True) == [("a", "orphaned"), ("a", "stopped"), ("c", "started")]
    assert observe(4) == [("b", "orphaned"), ("b", "unignored"), ("c", "orphaned"), ("c", "stopped")]
    assert observe(5, b=True) == [("b", "started")]
    assert [row.path for row in inventory.followed(5).collect()] == ["b"]
    with pytest.raises(LookupError):
        inventory.observe(spark.createDataFrame([], "path string, running boolean"), 9)


def test_the_position_of_the_journal_is_no_orphan(spark):
    state = spark.createDataFrame([(names.JOURNAL_LEDGER_KEY, True, False, False)], "path string, known boolean, followed boolean, ignored boolean")
    rows = inventory_step(state, spark.createDataFrame([], "path string, running boolean")).collect()
    assert [(r.path, r.known, r.changes) for r in rows] == [(names.JOURNAL_LEDGER_KEY, True, [])]


def test_filters_on_folders_reach_the_listing(spark, tmp_path, capsys):
    for kind in ("docker", "containerd"):
        for n in range(3):
            folder = tmp_path / "logs" / f"format={kind}" / f"container=c{n}"
            folder.mkdir(parents=True)
            (folder / "0.log").write_text(f"{kind} {n}\r\n\n")
    lines = scan_partitioned_lines(spark, str(tmp_path / "logs"), ["format", "container"])
    assert lines.count() == 6
    some = lines.where("format = 'docker' and container = 'c2'")
    assert [(r.value, r.format, r.container) for r in some.collect()] == [("docker 2", "docker", "c2")]
    some.explain("formatted")
    shown = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(format" in shown and "(container" in shown.split("PartitionFilters")[1]


def test_pod_logs_by_name(spark, tmp_path):
    for folder, container in (("n1_p1_i", "a"), ("n1_p2_i", "a"), ("n2_p1_i", "b[1]"), ("n1x_p1_i", "a")):
        at = tmp_path / folder / container
        at.mkdir(parents=True)
        (at / "0.log").write_text(f"{folder}/{container}\n")
        (at / "0.log.gz").write_text("not a log")

    def found(**chosen):
        lines = scan_pod_lines(spark, str(tmp_path), **chosen)
        assert all(r.value == f"{r.namespace}_{r.pod}_{r.id}/{r.container}" for r in lines.collect())
        return sorted(r.value for r in lines.collect())

    assert len(found()) == 4
    assert found(namespace="n1") == ["n1_p1_i/a", "n1_p2_i/a"]
    assert found(pod="p1", container="a") == ["n1_p1_i/a", "n1x_p1_i/a"]
    assert found(container="b[1]") == ["n2_p1_i/b[1]"]
    assert len(scan_pod_lines(spark, str(tmp_path), namespace="n1").inputFiles()) == 2
