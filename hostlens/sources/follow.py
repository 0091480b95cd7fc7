"""Event files that are still written to: a stream of the lines that are appended to them."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task takes; a line belongs to the task in whose bytes it ends.
SPLIT = 64 << 20
#: Bytes that are read at a time, of a line that is looked for, and before an offset as what it is known by.
BLOCK, LOOK, TAIL = 4 << 20, 1 << 16, 256


class Stretch(InputPartition):
    """The lines of a file that end in [begin, end); `tail` is the digest of what stands before begin, if that must be so."""

    def __init__(self, path: str, begin: int, end: int, tail: str | None) -> None:
        self.path, self.begin, self.end, self.tail = path, begin, end, tail


class AppendedLines(DataSource):
    """Lines of all files of a folder, as they are appended. A line counts when its end is written.

    Options: since=end leaves out what is there at the start; max_bytes bounds a micro-batch, the files
    written longest ago first; ledger names a file in which a bounded stream keeps where it is, which it
    needs when it starts again (without one its first micro-batch then takes all there is).

    A file is known by its path in the folder, its first line and the bytes before the offset up to which it
    was read. So files that start alike are kept apart, one that a rotation renames goes on under its new
    name, one that is written anew under an old name is read from its start, and so is a copy of a file that
    is still there. A file that is cut off below the offset is read from its start.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        return AppendedReader(o["path"], o.get("since", "start"), int(o.get("max_bytes", 0)), o.get("ledger"))


class AppendedReader(DataSourceStreamReader):
    """Offsets are, by path in the folder, `first` (the first line's digest and length), `end` (bytes read) and `tail` (the digest of the bytes before end)."""

    def __init__(self, path: str, since: str = "start", max_bytes: int = 0, ledger: str | None = None) -> None:
        self.path, self.since, self.max_bytes, self.ledger = path, since, max_bytes, ledger
        self.seen: dict[str, tuple[int, int, dict]] = {}
        self.last: dict | None = None

    # On the driver

    def _files(self) -> list[tuple[str, int, int]]:
        """(path in the folder, bytes, time of the last change) of each file that is not hidden, from one listing."""
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root))
        return [(x.base_name, x.size, x.mtime_ns or 0) for x in found if x.type == fs.FileType.File and x.size and x.base_name[0] not in "._"]

    def _open(self, name: str):
        system, root = fs.FileSystem.from_uri(self.path)
        return system.open_input_file(f"{root.rstrip('/')}/{name}")

    def _offset(self, name: str, end: int, first: str | None = None) -> dict | None:
        """A file's offset at `end`; None while it has no whole line."""
        with self._open(name) as file:
            first = first or _first_line(file, end)
            return first and {"first": first, "end": end, "tail": _tail(file, end)}

    def _read_up_to(self) -> dict | None:
        """Where the last planned micro-batch ended; with a ledger that is not there yet, where the stream starts."""
        if self.last is None and self.ledger:
            system, path = fs.FileSystem.from_uri(self.ledger)
            if system.get_file_info(path).type != fs.FileType.File:
                return self.initialOffset()
            with system.open_input_file(path) as file:
                self.last = json.loads(file.read())
        return self.last

    def _keep(self, offset: dict) -> None:
        self.last = offset
        if self.ledger:
            system, path = fs.FileSystem.from_uri(self.ledger)
            with system.open_output_stream(path) as file:
                file.write(json.dumps(offset).encode())

    def initialOffset(self) -> dict:
        if self.last is None:
            self._keep(self._all() if self.since == "end" else {})
        return self.last

    def _all(self) -> dict:
        """Offsets at the ends of all files; only files that have changed since the last listing are opened."""
        now = {}
        for name, size, changed in self._files():
            held = self.seen.get(name)
            now[name] = held if held and held[:2] == (size, changed) else (size, changed, self._offset(name, size))
        self.seen = now
        return {name: offset for name, (_, _, offset) in now.items() if offset}

    def latestOffset(self) -> dict:
        target = self._all()
        start = self._read_up_to()
        if not self.max_bytes or start is None:
            return target
        room, out = self.max_bytes, {}
        begins = self._begins(start, target)
        for name in sorted(target, key=lambda n: (self.seen[n][1], n)):
            begin, end = begins[name][0], target[name]["end"]
            take = min(room, end - begin)
            room -= take
            if begin + take == end:
                out[name] = target[name]
            elif not take and name in start and start[name]["end"] == begin:
                out[name] = start[name]
            elif begin + take:
                out[name] = self._offset(name, begin + take, target[name]["first"])
        return out

    def _begins(self, start: dict, end: dict) -> dict[str, tuple[int, str | None]]:
        """Of each file where its new bytes begin, and the digest of what must stand before.

        A path goes on where it was if its bytes up to there are the same; that is looked up where several files
        have its first line, and else left to the task. Any other path is the file that stood at a path of `start`
        if it holds the same bytes and that path does not go on; else it is new.
        """
        out: dict[str, tuple[int, str | None]] = {}
        alike = Counter(x["first"] for x in end.values())
        for name, now in end.items():
            old = start.get(name)
            if old and old["first"] == now["first"] and old["end"] <= now["end"]:
                if alike[now["first"]] == 1 or old == now or self._holds(name, old):
                    out[name] = old["end"], old["tail"]
        free = {name: old for name, old in start.items() if name not in out}
        for name, now in end.items():
            if name in out:
                continue
            for before in sorted(free, key=lambda n: (-_shared(n, name), n)):
                old = free[before]
                if old["first"] == now["first"] and old["end"] <= now["end"] and self._holds(name, old):
                    out[name] = old["end"], old["tail"]
                    del free[before]
                    break
            else:
                out[name] = 0, None
        return out

    def _holds(self, name: str, offset: dict) -> bool:
        with self._open(name) as file:
            return _tail(file, offset["end"]) == offset["tail"]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, (begin, tail) in self._begins(start, end).items():
            last = end[name]["end"]
            out += [Stretch(name, at, min(at + SPLIT, last), tail if at == begin else None) for at in range(begin, last, SPLIT)]
        self._keep(end)
        return out

    # In tasks

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        with self._open(partition.path) as file:
            begin = partition.begin
            if partition.tail is not None and _tail(file, begin) != partition.tail:
                begin = 0  # another file of the same name and first line
            held = [_before(file, begin)]
            file.seek(begin)
            while (at := file.tell()) < partition.end:
                block = file.read(min(BLOCK, partition.end - at))
                if not block:
                    return
                cut = block.rfind(b"\n")
                if cut < 0:
                    held.append(block)
                    continue
                lines = b"".join([*held, block[:cut]]).split(b"\n")
                held = [block[cut + 1 :]]
                for i in range(0, len(lines), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[i : i + 10_000]])], ["value"])


def _shared(a: str, b: str) -> int:
    """Characters that two names start with alike."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _first_line(file, size: int) -> str | None:
    """Digest and length of a file's first line; None while it has no end."""
    digest, at = hashlib.sha256(), 0
    file.seek(0)
    while at < size:
        block = file.read(min(LOOK, size - at))
        cut = block.find(b"\n")
        digest.update(block if cut < 0 else block[:cut])
        if cut >= 0:
            return f"{digest.hexdigest()[:32]}:{at + cut}"
        if not block:
            break
        at += len(block)
    return None


def _tail(file, end: int) -> str:
    """Digest of the bytes before an offset."""
    begin = max(0, end - TAIL)
    file.seek(begin)
    return hashlib.sha256(file.read(end - begin)).hexdigest()[:32]


def _before(file, at: int) -> bytes:
    """What stands between the last line end before `at` and `at`."""
    parts, end = [], at
    while end > 0:
        begin = max(0, end - LOOK)
        file.seek(begin)
        block = file.read(end - begin)
        cut = block.rfind(b"\n")
        parts.append(block[cut + 1 :])
        if cut >= 0:
            break
        end = begin
    return b"".join(reversed(parts))


def appended(spark: SparkSession, path: str, since: str = "start", max_bytes: int = 0, ledger: str | None = None):
    """A stream of the lines (value) appended to the files of a folder."""
    spark.dataSource.register(AppendedLines)
    reader = spark.readStream.format("appended_lines").option("since", since).option("max_bytes", max_bytes)
    return (reader.option("ledger", ledger) if ledger else reader).load(path)
