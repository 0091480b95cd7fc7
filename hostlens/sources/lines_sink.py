"""A sink of text lines that rotates by bytes, numbers its files on and shows them in one commit, for batches and streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

STAGING = "_staging"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its partition and the staged files with their lines and bytes."""

    partition: int
    files: list[tuple[str, int, int]]


class RotatedLines(DataSource):
    """Appends rows (value) as lines to the folder `path`.

    Option rotation_bytes: a file ends before the line that would make it as large (0: a task's lines are one
    file); a longer line has a file of its own. Tasks write into a hidden folder. A commit numbers the files
    that tasks report on from the largest number in the folder, in the order of partitions, and moves them to
    `commit=...` with one rename, so a reader of the folder sees all or none of them; what failed attempts
    leave is never seen. A micro-batch has the name of its number and of the option writer, and is not shown twice.
    Files of earlier commits are never written to.
    """

    @classmethod
    def name(cls) -> str:
        return "rotated_lines"

    def schema(self) -> str:
        return "value string"

    def _options(self) -> tuple[str, str, int]:
        return self.options["path"], self.options.get("base", "events.jsonl"), int(self.options.get("rotation_bytes", 100_000_000))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("rotated_lines appends")
        return BatchWriter(*self._options(), uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return StreamWriter(*self._options(), self.options.get("writer", "stream"))


class _Folder:
    """A folder with a staging folder of its own, which is made where it is first needed."""

    def __init__(self, path: str, base: str, rotation_bytes: int, name: str) -> None:
        self.path, self.base, self.rotation_bytes = path, base, rotation_bytes
        self.staging = f"{STAGING}/{name}"

    def _system(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, root.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = self._system()
        files, out, lines, size = [], None, 0, 0
        attempt = uuid.uuid4().hex
        system.create_dir(f"{root}/{self.staging}")

        def close() -> None:
            if out:
                out.close()
                files.append((f"{attempt}-{len(files)}", lines, size))

        for batch in batches:
            for value in batch.column(0).to_pylist():
                line = (value or "").encode() + b"\n"
                if out is None or self.rotation_bytes and lines and size + len(line) >= self.rotation_bytes:
                    close()
                    out, lines, size = system.open_output_stream(f"{root}/{self.staging}/{attempt}-{len(files)}"), 0, 0
                out.write(line)
                lines, size = lines + 1, size + len(line)
        close()
        return Written(TaskContext.get().partitionId(), files)

    def numbers(self) -> list[int]:
        """The numbers that files of the base name have, in the folder and in its commits."""
        system, root = self._system()
        names = [x.base_name for x in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File and f"/{STAGING}/" not in x.path]
        ends = [n[len(self.base) + 1 :] for n in names if n.startswith(f"{self.base}.")]
        return [int(n) for n in ends if n.isdigit()]

    def show(self, messages: list[Written | None], name: str) -> bool:
        """Moves the files of a commit into place; False if a commit of this name is there already."""
        system, root = self._system()
        place = f"{root}/commit={name}"
        files = [file for m in sorted((m for m in messages if m), key=lambda m: m.partition) for file, _, _ in m.files]
        shown = bool(files) and system.get_file_info(place).type == fs.FileType.NotFound
        if shown:
            ready = f"{root}/{self.staging}/ready-{name}"
            system.create_dir(ready)
            for number, file in enumerate(files, max(self.numbers(), default=0) + 1):
                system.move(f"{root}/{self.staging}/{file}", f"{ready}/{self.base}.{number}")
            system.move(ready, place)
        return shown

    def clear(self) -> None:
        system, root = self._system()
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class BatchWriter(_Folder, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.show(messages, f"batch-{uuid.uuid4().hex}")
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()


class StreamWriter(_Folder, DataSourceStreamArrowWriter):
    def __init__(self, path: str, base: str, rotation_bytes: int, writer: str) -> None:
        # Tasks and commits of a stream make writers of their own, which share the folder by its name.
        super().__init__(path, base, rotation_bytes, writer)
        self.writer = writer

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.show(messages, f"{self.writer}-{batchId:012d}")
        self.clear()

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.clear()
