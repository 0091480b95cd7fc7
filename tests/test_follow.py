"""Files that grow, rotate and are cut off while a stream follows them."""

import json
import os
import shutil

import pytest

from hostlens.sources import follow, jsonl

LINE = '{{"id":"aaaaaaaa-aaaa-aaaa-aaaa-{0:012d}","timestamp":"2026-03-13T10:00:00Z","hostname":"h","agent_id":"00000000-0000-0000-0000-000000000000","sensor_version":"1","source":"Sensor","category":"Network","severity":"Info","data":{{"type":"NetworkConnect","pid":{0},"image_path":"a","protocol":"TCP","src_addr":"10.0.0.1","src_port":1,"dst_addr":"93.184.216.34","dst_port":443,"direction":"Outbound"}}}}\n'


def run(stream, base):
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    query.awaitTermination()


def pids(spark, base):
    return sorted(spark.read.parquet(f"{base}/out").toPandas()["pid"].tolist())


def append(path, numbers, rest=""):
    with open(path, "a") as f:
        f.write("".join(LINE.format(n) for n in numbers) + rest)


def test_appends_rotation_and_partial_lines(spark, tmp_path):
    logs, base = tmp_path / "logs", str(tmp_path)
    logs.mkdir()
    live = str(logs / "events.jsonl")
    of = lambda: jsonl.follow_events(spark, str(logs)).select("data.pid")
    append(live, [1, 2], LINE.format(3)[:40])
    run(of(), base)
    assert pids(spark, base) == [1, 2]
    append(live, [], LINE.format(3)[40:])
    append(live, [4])
    run(of(), base)
    assert pids(spark, base) == [1, 2, 3, 4]
    append(live, [5])
    os.rename(live, str(logs / "events.1.jsonl"))
    append(live, [6, 7])
    run(of(), base)
    assert pids(spark, base) == [1, 2, 3, 4, 5, 6, 7]
    run(of(), base)
    with open(live, "w"):
        pass
    append(live, [8], "broken\n\n")
    run(of(), base)
    assert pids(spark, base) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_stretches_hold_each_line_once(tmp_path, monkeypatch):
    path = tmp_path / "a.txt"
    lines = ["x" * (i % 37) + str(i) for i in range(400)]
    path.write_text("\n".join(lines) + "\nnot yet")
    for split in (1, 7, 64, 1000, 1 << 20):
        monkeypatch.setattr(follow, "SPLIT", split)
        monkeypatch.setattr(follow, "LOOK", 16)
        monkeypatch.setattr(follow, "BLOCK", 50)
        reader = follow.AppendedReader(str(tmp_path))
        end = reader.latestOffset()
        assert values(reader, {}, end) == lines
    assert follow.AppendedReader(str(tmp_path), "end").initialOffset() == end
    assert reader.partitions(end, end) == []
    with open(path, "a") as f:
        f.write("!\nmore\n")
    assert values(reader, end, reader.latestOffset()) == ["not yet!", "more"]


def values(reader, start, end):
    return [v for part in reader.partitions(start, end) for batch in reader.read(part) for v in batch.column(0).to_pylist()]


class Follower:
    """Micro-batches of a folder, each from where the one before ended, with a new reader each time or the same."""

    def __init__(self, path, fresh=False, **options):
        self.make = lambda: follow.AppendedReader(str(path), **options)
        self.fresh, self.reader = fresh, self.make()
        self.at = self.reader.initialOffset()

    def take(self):
        if self.fresh:
            self.reader = self.make()
        start, self.at = self.at, json.loads(json.dumps(self.reader.latestOffset()))
        return values(self.reader, start, self.at)


def put(path, *lines, mode="a"):
    with open(path, mode) as f:
        f.write("".join(x + "\n" for x in lines))


@pytest.mark.parametrize("fresh", [False, True])
def test_files_with_one_first_line_are_kept_apart(tmp_path, fresh):
    one, two = tmp_path / "one.jsonl", tmp_path / "two.jsonl"
    put(two, "header", *[f"b{i}" for i in range(1, 9)])
    put(one, "header", "a single longer line than the others")
    f = Follower(tmp_path, fresh)
    assert sorted(f.take()) == sorted(["header", *[f"b{i}" for i in range(1, 9)], "header", "a single longer line than the others"])
    put(two, "b9")
    assert f.take() == ["b9"]
    put(one, "a2")
    assert f.take() == ["a2"] and f.take() == []


@pytest.mark.parametrize("fresh", [False, True])
def test_rotations_of_files_with_headers(tmp_path, fresh):
    """Two files with one header rotate at once, twice, and new ones take their names."""
    f = Follower(tmp_path, fresh)
    for x in "ab":
        put(tmp_path / f"{x}.log", "header", f"{x}1", f"{x}2")
    assert sorted(f.take()) == ["a1", "a2", "b1", "b2", "header", "header"]
    for x in "ab":
        put(tmp_path / f"{x}.log", f"{x}3")
        os.rename(tmp_path / f"{x}.log", tmp_path / f"{x}.log.1")
        put(tmp_path / f"{x}.log", "header", f"{x}4", f"{x}5", f"{x}6", f"{x}7")
    assert sorted(f.take()) == ["a3", "a4", "a5", "a6", "a7", "b3", "b4", "b5", "b6", "b7", "header", "header"]
    for x in "ab":
        os.rename(tmp_path / f"{x}.log.1", tmp_path / f"{x}.log.2")
        os.rename(tmp_path / f"{x}.log", tmp_path / f"{x}.log.1")
        put(tmp_path / f"{x}.log.1", f"{x}8")
        put(tmp_path / f"{x}.log", "header", f"{x}9")
    assert sorted(f.take()) == ["a8", "a9", "b8", "b9", "header", "header"]
    assert f.take() == []


def test_copies_and_files_that_are_cut_off(tmp_path):
    live, copy = tmp_path / "live.log", tmp_path / "live.log.1"
    put(live, "header", "x1", "x2")
    f = Follower(tmp_path)
    assert f.take() == ["header", "x1", "x2"]
    put(live, "x3")
    shutil.copy(live, copy)
    put(live, "y1", mode="w")  # rotated by copy and cut
    assert sorted(f.take()) == ["x3", "y1"]
    shutil.copy(live, tmp_path / "kept.log")  # a copy beside its original is a file of its own
    put(live, "y2")
    assert sorted(f.take()) == ["y1", "y2"]
    put(live, "header", mode="w")
    assert f.take() == ["header"]
    put(live, "header", "z1", "z2", mode="w")  # written anew under the same first line, longer than what was read
    assert f.take() in (["header", "z1", "z2"], ["z1", "z2"])


def test_another_file_of_the_same_name_and_first_line(tmp_path):
    live = tmp_path / "live.log"
    put(live, "header", "old 1", "old 2")
    f = Follower(tmp_path)
    f.take()
    os.remove(live)
    put(live, "header", "new 1", "new 2", "new 3")
    assert f.take() == ["header", "new 1", "new 2", "new 3"]


@pytest.mark.parametrize("fresh", [False, True])
def test_micro_batches_are_bounded(tmp_path, fresh):
    logs = tmp_path / "logs"
    logs.mkdir()
    lines = {f"f{i}": [f"f{i} line {k} " + "x" * (k % 50) for k in range(60)] for i in range(5)}
    for name, rows in lines.items():
        put(logs / name, *rows)
    f = Follower(logs, fresh, max_bytes=700, ledger=str(tmp_path / "ledger.json"))
    got, batches = [], 0
    while part := f.take():
        assert sum(len(x) + 1 for x in part) <= 700 + 100  # a line that began before is whole
        got += part
        batches += 1
    assert batches >= 15 and sorted(got) == sorted(x for rows in lines.values() for x in rows)


def test_files_that_do_not_change_are_not_opened(tmp_path, monkeypatch):
    for i in range(300):
        put(tmp_path / f"f{i}", f"first of {i}", "second")
    f, opened = Follower(tmp_path), []
    assert len(f.take()) == 600
    old = follow.AppendedReader._open
    monkeypatch.setattr(follow.AppendedReader, "_open", lambda self, name: opened.append(name) or old(self, name))
    assert f.reader.latestOffset() == f.at and opened == []
    put(tmp_path / "f7", "third")
    assert f.reader.latestOffset()["f7"]["end"] > f.at["f7"]["end"] and opened == ["f7"]


def test_long_first_lines_tell_files_apart(tmp_path):
    put(tmp_path / "a", "x" * 300_000 + "a", "1")
    put(tmp_path / "b", "x" * 300_000 + "b", "2")
    f = Follower(tmp_path)
    assert sorted(len(x) for x in f.take()) == [1, 1, 300_001, 300_001]
    assert f.at["a"]["first"] != f.at["b"]["first"] and f.at["a"]["first"].endswith(":300001")


def test_a_stream_with_a_bound_reads_all(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for i in range(4):
        append(str(logs / f"{i}.jsonl"), range(10 * i, 10 * i + 10))
    stream = jsonl.follow_events(spark, str(logs), max_bytes=4000, ledger=str(tmp_path / "ledger")).select("data.pid")
    query = stream.writeStream.format("memory").queryName("bounded_follow").start()
    query.processAllAvailable()
    assert sorted(r[0] for r in spark.table("bounded_follow").collect()) == list(range(40))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 4
    query.stop()
