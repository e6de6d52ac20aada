import json
import os

import pytest

from podlens.streaming.ledger_tail import LedgerTailReader, owned, stream_tail_ledger


def reader(tmp_path, **options):
    return LedgerTailReader({"path": f"{tmp_path}/logs/*/*.log", "ledger": f"{tmp_path}/ledger", "shards": "3", **options})


def batch(r, start, end):
    rows = []
    for part in r.partitions(start, end):
        rows += [row for found in r.read(part) for row in found.to_pylist()]
    return sorted(row["value"] for row in rows if row["error"] is None), [row["path"] for row in rows if row["error"]]


def write(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open(mode) as file:
        file.write(text)


def test_every_file_has_one_shard(tmp_path):
    for i in range(40):
        write(tmp_path / "logs" / f"p{i}" / "a.log", "x\n")
    parts = [list(owned(f"{tmp_path}/logs/*/*.log", shard, 3)) for shard in range(3)]
    assert sorted(sum(parts, [])) == sorted(str(p) for p in tmp_path.glob("logs/*/*.log")) and all(parts)
    flat = [list(owned(f"{tmp_path}/logs/p*", shard, 3)) for shard in range(3)]
    assert sum(map(len, flat)) == 40
    with pytest.raises(ValueError):
        reader(tmp_path, path="/logs/a.log")


def test_growing_rotated_emptied_and_lost(tmp_path):
    logs = tmp_path / "logs"
    for name in "abcd":
        write(logs / name / "0.log", f"{name}1\n{name}2\npart")
    r = reader(tmp_path)
    start, first = r.initialOffset(), r.latestOffset()
    assert batch(r, start, first) == (sorted(f"{n}{i}" for n in "abcd" for i in (1, 2)), [])
    write(logs / "a" / "0.log", "ial\na3\n", "a")
    write(logs / "b" / "0.log", "ial\nb3\nend", "a")
    os.rename(logs / "b" / "0.log", logs / "b" / "0.log.1")
    write(logs / "b" / "0.log", "b4\n")
    write(logs / "c" / "0.log", "new1\n")
    (logs / "d" / "0.log").unlink()
    write(logs / "e" / "0.log", "e1\r\n\n")
    second = r.latestOffset()
    expected = sorted(["partial", "a3", "partial", "b3", "end", "b4", "new1", "e1"]), [str(logs / "d" / "0.log")]
    assert batch(r, first, second) == expected
    # The batch again, by another process and after more was written, gives the same lines.
    write(logs / "a" / "0.log", "a4\n", "a")
    assert batch(reader(tmp_path), first, second) == expected
    again = reader(tmp_path)
    third = again.latestOffset()
    assert third["version"] > second["version"]
    assert batch(again, second, third) == (["a4"], [])
    r.commit(third)
    assert os.listdir(tmp_path / "ledger") == [str(third["version"])]
    with pytest.raises(RuntimeError, match="lost"):
        batch(again, first, again.latestOffset())


def test_emptied_file_that_begins_alike(tmp_path):
    file = tmp_path / "logs" / "a" / "0.log"
    write(file, "x" * 2000 + "\nold1\nold2\n")
    r = reader(tmp_path)
    start, first = r.initialOffset(), r.latestOffset()
    assert batch(r, start, first)[0] == ["old1", "old2", "x" * 2000]
    write(file, "x" * 2000 + "\nnew1\nnew2\nnew3\n")
    assert batch(r, first, r.latestOffset())[0] == ["new1", "new2", "new3", "x" * 2000]


def test_limits_and_start_at_the_end(tmp_path):
    write(tmp_path / "logs" / "a" / "0.log", "".join(f"line{i}\n" for i in range(10)) + "x" * 50 + "\n")
    r = reader(tmp_path, maxbytesperfile="12")
    at, found = r.initialOffset(), []
    for _ in range(12):
        following = r.latestOffset()
        found.append(batch(r, at, following)[0])
        at = following
    assert sum(found, []) == [f"line{i}" for i in range(10)] + ["x" * 50] and max(map(len, found)) == 2
    r = reader(tmp_path, fromtail="true", ledger=f"{tmp_path}/other")
    start, end = r.initialOffset(), r.latestOffset()
    assert batch(r, start, end) == ([], [])
    write(tmp_path / "logs" / "a" / "0.log", "more\n", "a")
    write(tmp_path / "logs" / "b" / "0.log", "new\n")
    assert batch(r, end, r.latestOffset()) == (["more", "new"], [])


def test_many_files_over_several_batches(spark, tmp_path):
    """20,000 files: the offset stays one number, and the driver makes one task for each shard."""
    logs = tmp_path / "logs"
    for i in range(20_000):
        folder = logs / f"pod{i // 20}"
        if i % 20 == 0:
            folder.mkdir(parents=True)
        (folder / f"{i}.log").write_text(f"first {i}\n")
    out, checkpoint = str(tmp_path / "out"), tmp_path / "checkpoint"

    def once():
        stream = stream_tail_ledger(spark, f"{logs}/*/*.log", str(tmp_path / "ledger"), shards=8)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(checkpoint))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress

    progress = once()
    assert progress.numInputRows == 20_000
    for i in range(0, 20_000, 100):
        file = logs / f"pod{i // 20}" / f"{i}.log"
        if i % 300 == 0:
            os.rename(file, f"{file}.1")
            file.write_text(f"second {i}\n")
        elif i % 300 == 100:
            file.write_text(f"2nd {i}\n")
        else:
            with file.open("a") as f:
                f.write(f"second {i}\n")
    assert once().numInputRows == 200
    once()
    values = {row.value for row in spark.read.parquet(out).collect()}
    assert len(values) == 20_200 and spark.read.parquet(out).count() == 20_200
    offsets = [(checkpoint / "offsets" / str(n)).read_text().splitlines()[-1] for n in range(2)]
    assert all(list(json.loads(offset)) == ["version"] for offset in offsets)
