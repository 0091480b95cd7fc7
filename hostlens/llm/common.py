"""Helpers shared by the training-data operators: scratch tables, text batches, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder serves a local master; on a cluster that is an error,
    since executors would each see a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN_DIRS:
        path = tempfile.mkdtemp(prefix="spark-hostlens-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN_DIRS[context.applicationId] = path
    return _OWN_DIRS[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hostlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made, when nothing reads them any more.

    What a lazy result still reads stays; who names spark.checkpoint.dir cleans it after a job.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that go to a Python worker at once: texts are whole, so their number is what bounds a batch.
BATCH_ROWS = 2000


def small_batches() -> None:
    """Lowers the session's rows an Arrow batch to BATCH_ROWS, if they are more."""
    conf, key = SparkSession.active().conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def utf8(text: Column) -> Column:
    """Text as UTF-8 bytes; null is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def byte_chunks(batch: pa.RecordBatch, column: str, most: int = 300_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose texts have at most `most` bytes together (one text may have more).

    Yields the slice, the bytes of its texts one after another, and the offsets at which they start
    and end.
    """
    values = batch.column(column)
    wide = pa.types.is_large_binary(values.type)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32, len(values) + 1 + values.offset)[values.offset :].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(values):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in batches that are sorted by them; a run may span batches.

    Yields tables that hold whole runs, many runs in a table; `run_starts` finds them.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = run_starts(batch, keys)
        if held and not _same(held[-1], held[-1].num_rows - 1, batch, 0, keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(starts) > 1:
            cut = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int, keys: list[str]) -> bool:
    return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)


def run_starts(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys (non-null integers) start."""
    new = np.zeros(rows.num_rows, bool)
    if rows.num_rows:
        new[0] = True
    for key in keys:
        x = np.asarray(rows.column(key))
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long: rows (id, root), root the smallest id.

    Large-star and small-star steps in turn. A node's least neighbour is found by a grouping with
    partial minima, written, and joined back: as a table of its own the join reads it by an exchange of
    its own, so a node with very many edges is split by the skew join. Ids without an edge to another id
    have no row. Spent tables are deleted.
    """
    edge = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(edges.where("a <> b").select(*edge).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if tuple(state) == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = tuple(state)
        both = now.union(now.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        dropped(now, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
        dropped(large, least)
