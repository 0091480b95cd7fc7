"""Executable files on disk, read by ranges: a batch source."""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.pe import _SCHEMA, Image, parse

#: Bytes of a read, reads that are kept of a file, files of a task at least, and tasks beyond which these take more files.
BLOCK, KEPT, FILES, TASKS = 1 << 15, 16, 64, 1024
#: Larger files are flagged, and their code is not read.
LARGEST = 64 << 20


class Files(InputPartition):
    def __init__(self, names: list[tuple[str, int]]) -> None:
        self.names = names


class Executables(DataSource):
    """What parse() tells of each file of a folder and the folders in it, with size, too_large and bytes_read.

    A task opens its files and reads headers and the tables that these point to in blocks of 32 KB, so what is
    read of a file does not grow with it. Option code=true reads the code too, up to 4 MB, but not of files of
    over 64 MB, which are flagged too_large. A file that cannot be read is not valid.
    """

    @classmethod
    def name(cls) -> str:
        return "executables"

    def schema(self) -> str:
        return f"path string, size long, too_large boolean, bytes_read long, {_SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        return ExecutablesReader(self.options["path"], self.options.get("code", "false") == "true", [f.name for f in schema])


class Ranges:
    """A file's bytes by ranges: blocks of which the last used are kept, long ranges as they are; counts what it reads."""

    def __init__(self, file) -> None:
        self.file, self.blocks, self.count = file, OrderedDict(), 0

    def _from(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        self.count += len(data)
        return data

    def __call__(self, at: int, n: int) -> bytes:
        if n > BLOCK:
            return self._from(at, n)
        out = b""
        for number in range(at // BLOCK, (at + n - 1) // BLOCK + 1):
            if number not in self.blocks:
                self.blocks[number] = self._from(number * BLOCK, BLOCK)
                if len(self.blocks) > KEPT:
                    self.blocks.popitem(last=False)
            self.blocks.move_to_end(number)
            out += self.blocks[number]
        return out[at % BLOCK :][:n]


class ExecutablesReader(DataSourceReader):
    def __init__(self, path: str, code: bool, names: list[str]) -> None:
        self.path, self.code, self.names = path, code, names

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        one = system.get_file_info(root)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File)
        each = max(FILES, -(-len(files) // TASKS))
        return [Files(files[i : i + each]) for i in range(0, len(files), each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for path, size in partition.names:
            large, ranges, row = size > LARGEST, None, {"valid": False}
            try:
                with system.open_input_file(path) as file:
                    ranges = Ranges(file)
                    row = parse(Image(size, ranges), self.code and not large)
            except (OSError, struct.error):
                pass
            row |= {"path": path, "size": size, "too_large": large, "bytes_read": ranges.count if ranges else 0}
            for structs in ("sections", "imports"):
                row[structs] = row.get(structs) and [tuple(x.values()) for x in row[structs]]
            yield tuple(row.get(n) for n in self.names)


def read_files(spark: SparkSession, path: str, code: bool = False) -> DataFrame:
    """Executable files of a folder (or one file) as pe's operators take them."""
    spark.dataSource.register(Executables)
    return spark.read.format("executables").option("code", str(code).lower()).load(path)
