"""Work that is dealt to more tasks as tables grow."""

import os
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from podlens import session
from podlens.plans import queries, workload
from podlens.session import ensure_parallel, spread_rows
from podlens.sources.containers import container_catalog_docker
from podlens.options import DeliveryOptions
from podlens.streaming.sinks import DeliveryKey, FileSink, Sent, send


def test_configs_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workload, "CONFIGS_PER_TASK", 20)
    ids = [f"id{i}" for i in range(300)] + ["id7", None]
    rows = spark.createDataFrame([(name, f'{{"ID":"{name}"}}' if name else "{}") for name in ids], "folder string, value string")
    dealt = spread_rows(rows, workload.CONFIGS_PER_TASK, "folder")
    assert dealt.rdd.getNumPartitions() == 16
    for root in (f"{tmp_path}/plain", f"file:{tmp_path}/uri"):
        workload.write_configs(rows, root)
        found = container_catalog_docker(spark, f"{root}/*/*.txt").select("id", "path").collect()
        assert sorted(r.id for r in found) == sorted(set(ids) - {None})
        at = root.removeprefix("file:")
        assert all(r.path == f"{at}/folder={r.id}/{r.id}-json.log" for r in found)
        assert open(f"{at}/folder=id7/config.txt").read() == '{"ID":"id7"}\n' * 2
        assert len(os.listdir(at)) == 301


def test_tasks_grow_in_number_not_in_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(1000, numPartitions=1)
    assert ensure_parallel(rows, "id").rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert ensure_parallel(rows, "id").rdd.getNumPartitions() == 100
    # As many splits as cores are too few when they are large.
    assert ensure_parallel(spark.range(1000, numPartitions=cores), "id").rdd.getNumPartitions() == 100
    assert ensure_parallel(spark.range(1000, numPartitions=100), "id").rdd.getNumPartitions() == 100
    assert ensure_parallel(spark.range(0, numPartitions=1), "id").count() == 0


def chunk_files(folder):
    return sorted(name for _, _, names in os.walk(f"{folder}/chunks") for name in names)


def test_chunks_share_files(tmp_path):
    messages, options = [f"{i:04}" for i in range(1000)], DeliveryOptions(batch_size=10, retry_seconds=0, max_attempts=2)
    failures = [OSError("first file"), OSError("last file")]

    class Flaky(FileSink):
        def _put(self, place, name, content):
            if failures and place.endswith("batch=0") and (len(failures) == 2 or "-99-" in name):
                raise failures.pop(0)
            super()._put(place, name, content)

    open_sink = lambda: Flaky(str(tmp_path), file_bytes=2000)
    assert send(open_sink, messages, "j", 0, 5, options, "a") == (1000, 100)
    assert not failures
    # 40 chunks of 10 messages of 5 bytes fill a file.
    files = chunk_files(tmp_path)
    assert files == ["5-0-39-a.txt", "5-40-79-a.txt", "5-80-99-a.txt"]
    folder = f"{tmp_path}/chunks/job=j/batch=0"
    assert "".join(open(f"{folder}/{name}").read() for name in files).split() == messages
    with pytest.raises(FileNotFoundError, match="1 chunks"):
        open_sink().finish("j", 0, {5: Sent(100, "a"), 6: Sent(1, "b")})
    sink = open_sink()
    sink.deliver(["x"], DeliveryKey("j", 0, 6, 0, "b"))
    sink.finish("j", 0, {5: Sent(100, "a"), 6: Sent(1, "b")})
    assert chunk_files(tmp_path) == [*files, "6-0-0-b.txt"]


def test_files_of_streams_follow_the_lines_and_spans_are_batches(spark, tmp_path, monkeypatch):
    """Segment files do not multiply with the tasks, and each span of days is one micro-batch, however small."""
    import glob

    rows = spark.range(400, numPartitions=1).selectExpr(
        "id event_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(if(id < 2, 0, 6)) ts", "'view' event_type",
        "id % 24 user_id", "1.5D value", "'{}' props",
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(workload, "TASK_ROWS", 10)
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    root = workload.write_segments(spark, str(tmp_path)).removeprefix("file:")
    files, folders = (len(glob.glob(f"{root}/*/*/*/{part}")) for part in ("*.txt", ""))
    assert files == folders == 12
    assert spark.read.text(root).count() == 400
    monkeypatch.setattr(workload, "SEGMENT_ROWS", 10)
    root = workload.write_segments(spark, str(tmp_path)).removeprefix("file:")
    assert len(glob.glob(f"{root}/*/*/*/*.txt")) > 24
    sizes = []
    for lines in workload.stream_spans(spark, str(tmp_path), 5):
        job = lines.writeStream.foreachBatch(lambda batch, _: sizes.append((batch.count(), batch.selectExpr("input_file_name()").distinct().count())))
        job.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [size for size, _ in sizes] == [1, 391] and sizes[1][1] > 30


def events_of_one_id(spark, folder, n):
    """Rows that are all alike and have no id."""
    rows = spark.range(n, numPartitions=1).selectExpr(
        "CAST(NULL AS BIGINT) event_id", "timestamp'2024-01-01 00:00:00' ts", "'view' event_type", "7L user_id", "1.5D value", "'{}' props"
    )
    rows.write.parquet(f"{folder}/events.parquet")


# Times each event is put out.
ROWS_PER_EVENT = {"assembled": 1, "json_records": 1, "united_outputs": 2, "kept_records_grouped": 1}


@pytest.mark.parametrize("name", ROWS_PER_EVENT)
def test_equal_ids_fill_no_task(spark, tmp_path, monkeypatch, name):
    events_of_one_id(spark, tmp_path, 400)
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    found = queries.REGISTRY[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(row["count"] for row in found) == 400 * ROWS_PER_EVENT[name]
    assert max(row["count"] for row in found) <= 20


def test_equal_ids_fill_no_task_of_the_sink(spark, tmp_path, monkeypatch):
    events_of_one_id(spark, tmp_path, 400)
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    monkeypatch.setattr(queries, "scratch_dir", lambda spark, label: f"{tmp_path}/{label}")
    delivered = queries.REGISTRY["written_to_sink"](spark, str(tmp_path)).collect()
    assert [row["n"] for row in delivered] == [400]
    # A file for each task.
    lines = [len(open(path).readlines()) for path in (tmp_path / "sink" / "chunks").rglob("*.txt")]
    assert sum(lines) == 400 and max(lines) <= 20


def events_in_one_row_group(folder, n):
    """A file that Spark cuts into many splits, while all its rows are in one of them."""
    day = datetime(2024, 1, 1)
    rows = {
        "event_id": list(range(n)), "ts": [day] * n, "user_id": [7] * n, "event_type": ["view"] * n, "value": [1.5] * n,
        "props": [f'{{"note": "{i:0200}"}}' for i in range(n)],
    }
    table = pa.table(rows).set_column(1, "ts", pa.array(rows["ts"], pa.timestamp("us")))
    pq.write_table(table, f"{folder}/events.parquet", row_group_size=n, compression="none", use_dictionary=False)


@pytest.fixture
def small_splits(spark):
    changed = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "0"}
    before = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_empty_splits_do_not_count(spark, tmp_path, monkeypatch, small_splits):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    events_in_one_row_group(tmp_path, 400)
    events = workload.table(spark, str(tmp_path), "events")
    assert events.rdd.getNumPartitions() > 40
    assert [row["count"] for row in events.groupBy(F.spark_partition_id()).count().collect()] == [400]
    dealt = ensure_parallel(events)
    assert dealt.rdd.getNumPartitions() == 40 and dealt.count() == 400
    # Splits enough with rows, one of them too large.
    uneven = spark.range(400, numPartitions=80).union(spark.range(100, numPartitions=1))
    assert ensure_parallel(uneven).rdd.getNumPartitions() == 50


@pytest.mark.parametrize("name", ROWS_PER_EVENT)
def test_one_row_group_fills_no_task(spark, tmp_path, monkeypatch, small_splits, name):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    events_in_one_row_group(tmp_path, 400)
    found = queries.REGISTRY[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(found) >= 30 and max(row["count"] for row in found) <= 20


def test_one_row_group_fills_no_task_of_the_sink(spark, tmp_path, monkeypatch, small_splits):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    events_in_one_row_group(tmp_path, 400)
    monkeypatch.setattr(queries, "scratch_dir", lambda spark, label: f"{tmp_path}/{label}")
    assert sum(row["n"] for row in queries.REGISTRY["written_to_sink"](spark, str(tmp_path)).collect()) > 300
    lines = [len(open(path).readlines()) for path in (tmp_path / "sink" / "chunks").rglob("*.txt")]
    assert len(lines) >= 30 and max(lines) <= 20


def test_messages_are_built_once(spark, tmp_path, monkeypatch):
    events_of_one_id(spark, tmp_path, 400)
    built, record_lines = spark.sparkContext.accumulator(0), queries.record_lines

    def counted(lines):
        def count(batches):
            for batch in batches:
                built.add(batch.num_rows)
                yield batch

        return record_lines(lines).mapInArrow(count, "value string")

    monkeypatch.setattr(queries, "record_lines", counted)
    delivered = queries.REGISTRY["delivered_batches"](spark, str(tmp_path)).collect()
    assert [row["n"] for row in delivered] == [800]
    assert built.value == 400
