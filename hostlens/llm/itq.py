"""Embedding near-dedup by iterative quantisation.

Rotations of the principal directions are learnt so that the signs of a rotated vector are balanced bits
that lose little. The bits are cut into tables; vectors whose bits agree in a table meet in its bucket,
where their cosine decides. The number of tables is measured: tables are added until pairs at the
threshold, made from sampled vectors, are found with the wanted probability, nearer pairs more often.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, groups, run_starts, written

RECALL = 0.97
#: Tables are made narrower while more than this many seem to be needed.
WIDE_TABLES = 64
#: With so many tables and too little found they are made anew, narrower.
MOST_TABLES = 1024
#: A table's key has at most so many bits, enough for buckets of 8 among 8e12 vectors.
KEY_BITS = 40


@dataclass
class Codes:
    """Projections whose signs are the bits, cut into tables of `width` bits."""

    mean: np.ndarray
    projections: np.ndarray
    width: int
    tables: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The tables' keys of unit vectors, one row each."""
        bits = (vectors - self.mean) @ self.projections > 0
        weights = 1 << np.arange(self.width, dtype=np.int64)
        return np.stack([bits[:, t * self.width : (t + 1) * self.width] @ weights for t in range(self.tables)], axis=1).astype(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def pairs_at(sample: np.ndarray, threshold: float, count: int = 4000, seed: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sampled unit vectors, and these turned to the threshold's cosine: in any direction, and towards other sampled vectors."""
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(len(sample), size=count)]
    any_way = rng.normal(size=x.shape)
    turned = []
    for other in (any_way, sample[rng.integers(len(sample), size=count)]):
        side = other - (other * x).sum(1, keepdims=True) * x
        same = np.linalg.norm(side, axis=1) < 1e-6
        side[same] = (any_way - (any_way * x).sum(1, keepdims=True) * x)[same]
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        turned.append(unit(threshold * x + np.sqrt(1 - threshold**2) * side))
    return x, turned


def fit(sample: np.ndarray, total: int, threshold: float, recall: float = RECALL, rounds: int = 30, seed: int = 0) -> Codes:
    """Learns rotations from a sample of unit vectors; `total` vectors are to be indexed.

    The width of a table grows with the logarithm of their number, so buckets stay small. Vectors that
    share a mean differ in more bits than their angle says, as bits are of what is left without it. Of
    a large sample a fifth is kept for counting, since rotations suit the vectors they are learnt from.
    """
    dim = sample.shape[1]
    one, others = pairs_at(sample[::5] if len(sample) >= 2000 else sample, threshold)
    sample = np.delete(sample, np.s_[::5], axis=0) if len(sample) >= 2000 else sample
    mean = sample.mean(0)
    centred = sample - mean
    _, _, directions = np.linalg.svd(centred, full_matrices=False) if len(sample) < dim else (None, None, np.linalg.eigh(centred.T @ centred)[1][:, ::-1].T)
    basis = np.vstack((directions, np.zeros((dim - len(directions), dim)))).T
    values = centred @ basis
    width = int(np.clip(round(np.log2(max(total, 2) / 8)), 4, KEY_BITS))
    rng = np.random.default_rng(seed)
    agree = [np.zeros((len(one), 0), bool) for _ in others]
    found = [np.zeros(len(one), bool) for _ in others]
    turned: list[np.ndarray] = []
    tables = 0
    while True:
        if (tables + 1) * width > dim * len(turned):
            rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            for _ in range(rounds):
                left, _, right = np.linalg.svd(np.where(values @ rotation > 0, 1.0, -1.0).T @ values)
                rotation = (left @ right).T
            turned.append((basis @ rotation)[:, rng.permutation(dim)])
            bits = (one - mean) @ turned[-1] > 0
            agree = [np.hstack((a, bits == ((y - mean) @ turned[-1] > 0))) for a, y in zip(agree, others)]
            if len(turned) == 1:
                share = min(a.mean() for a in agree)
                while width > 4 and (1 - share**width) ** WIDE_TABLES > 1 - recall:
                    width -= 1
            continue
        for a, f in zip(agree, found):
            f |= a[:, tables * width : (tables + 1) * width].all(1)
        tables += 1
        by_angle = (1 - np.arccos(threshold) / np.pi) ** width
        fewest = min(MOST_TABLES, max(4, int(np.ceil(np.log(1 - recall) / np.log(1 - by_angle)))))
        if tables >= fewest and min(f.mean() for f in found) >= recall:
            return Codes(mean, np.hstack(turned), width, tables)
        if tables == MOST_TABLES:
            width, tables, found = width - 1, 0, [np.zeros(len(one), bool) for _ in others]


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _joined(near: np.ndarray) -> np.ndarray:
    """For each row of a matrix of links the least number of its component's rows."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] >= 0:
            continue
        reached = np.zeros(len(near), bool)
        reached[i] = True
        fresh = np.array([i])
        while len(fresh):
            now = near[fresh].any(0) & ~reached
            reached |= now
            fresh = np.flatnonzero(now)
        root[reached] = i
    return root


def linked(vectors: DataFrame, threshold: float = 0.95, sample: int = 20_000, most: int = 2048) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Equal vectors are one class, whose members link with each other. n_links counts the other rows with a
    cosine of at least `threshold` that are found (none below is); component_id is the smallest vec_id
    reachable. Vectors of different lengths have no cosine; each length has an index of its own, and one
    of at most `most` classes is a single bucket, compared whole. Vectors that are null, empty, zero, or
    hold null or non-finite components, and rows without a vec_id, link with nothing: n_links 0,
    component_id their vec_id. The rotations are fitted on about `sample` classes (fewer of
    over 200 components, 2000 at least), chosen by a hash; every row is indexed. A bucket with more than `most` vectors is cut into parts that meet pairwise
    in cells. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    wide = "<f4" if kind == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast(kind)).alias("v"))
    rows = rows.withColumn("v", F.when(F.size("v") > 0, F.col("v")))
    rows = rows.withColumn("cls", F.when(_valid(F.col("v")) & F.col("vec_id").isNotNull(), F.xxhash64("v")))
    classes = written(rows.where("cls IS NOT NULL").groupBy("cls", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "classes")
    names = written(rows.select("vec_id", "cls"), "names")

    def keyed(codes):
        """Rows of vectors into rows of (bucket, vector) for each table; without codes a length is one bucket."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 2000):
                    part = batch.slice(i, 2000)
                    raw = np.asarray(part.column("v").flatten()).astype(wide)
                    size = np.asarray(part.column("dim"))
                    if codes is None:
                        ends = np.cumsum(size)
                        keys, tables = size.astype(np.int64)[:, None], 1
                        packed = [raw[b - n : b].tobytes() for b, n in zip(ends.tolist(), size.tolist())]
                    else:
                        keys = codes.value.of(unit(raw.reshape(len(size), -1).astype(float)))
                        tables = keys.shape[1]
                        packed = [x.tobytes() for x in raw.reshape(len(size), -1)]
                    take = pa.array(np.repeat(np.arange(len(size)), tables))
                    every = pa.array([x.tobytes() for x in keys], pa.binary()).take(take)
                    key = pa.array((np.arange(tables)[None] << KEY_BITS | keys).ravel())
                    yield pa.RecordBatch.from_arrays([key, *[part.column(c).take(take) for c in ("cls", "id", "copies", "dim")], pa.array(packed, pa.binary()).take(take), every], ["bucket", "cls", "id", "copies", "dim", "vector", "codes"])

        return of

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["dim", "bucket", "cell"]):
            starts = [*run_starts(table, ["dim", "bucket", "cell"]).tolist(), table.num_rows]
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, j in zip(starts, starts[1:]):
                if j == i + 1:
                    continue
                part = table.slice(i, j - i)
                data = unit(np.frombuffer(b"".join(part.column("vector").to_pylist()), wide).reshape(j - i, -1).astype(float))
                keys = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.int64).reshape(j - i, -1)
                near = np.minimum(data @ data.T, 1.0) >= threshold
                np.fill_diagonal(near, False)
                slot, both = np.asarray(part.column("part")), np.asarray(part.column("both"))
                if both[0]:  # a cell of two parts; pairs within one meet in its own cell
                    near &= slot[:, None] != slot[None]
                if not near.any():
                    continue
                t = int(part.column("bucket")[0].as_py() >> KEY_BITS)
                counted = near.copy()
                for earlier in range(t):  # a pair counts in the first table in which it meets
                    a, b = np.nonzero(counted)
                    again = keys[a, earlier] == keys[b, earlier]
                    counted[a[again], b[again]] = False
                cls, ids, copies = (np.asarray(part.column(c)) for c in ("cls", "id", "copies"))
                order = np.argsort(ids, kind="stable")
                root = _joined(near[np.ix_(order, order)])
                a = ids[order]
                for k, x in enumerate((cls[order], (counted @ copies)[order], a, a[root])):
                    out[k].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["cls", "n", "a", "b"])

    def met(mine: DataFrame, codes) -> DataFrame:
        """Rows (cls, n, a, b) of what meets: links counted for a class, and links (a, b) that join its component."""
        buckets = mine.select("cls", "id", "copies", "dim", "v").mapInArrow(keyed(codes), "bucket long, cls long, id long, copies long, dim int, vector binary, codes binary")
        large = written(buckets.groupBy("dim", "bucket").count().where(F.col("count") > most).select("dim", "bucket", F.ceil(F.col("count") / most).alias("parts")), "large")
        dealt = buckets.join(large, ["dim", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("parts")))
        cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.struct((F.least(j, F.col("part")) * F.col("parts") + F.greatest(j, F.col("part"))).alias("cell"), (j != F.col("part")).alias("both")))
        dealt = dealt.withColumn("at", F.explode(cells)).select("dim", "bucket", F.col("at.cell").alias("cell"), F.col("at.both").cast("int").alias("both"), "part", "cls", "id", "copies", "vector", "codes")
        out = written(dealt.repartition("dim", "bucket", "cell").sortWithinPartitions("dim", "bucket", "cell").mapInArrow(compare, "cls long, n long, a long, b long"), "found")
        dropped(large)
        return out

    # A length is large with over `most` classes, so there are fewer of them than classes / most.
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().where(F.col("count") > most).collect()}
    found = met(classes.where(~F.col("dim").isin(list(sizes))) if sizes else classes, None)
    for dim, total in sorted(sizes.items()):
        mine, rows_wanted = classes.where(F.col("dim") == dim), min(sample, max(2000, 4_000_000 // dim))
        chosen = mine.where(F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(1_000_000)) < min(1.0, rows_wanted / total) * 1_000_000).orderBy("cls").select("v").limit(2 * rows_wanted).collect()
        codes = fit(unit(np.array([r["v"] for r in chosen] or [r["v"] for r in mine.orderBy("cls").limit(2).collect()], float)), total, threshold)
        found = found.union(met(mine, spark.sparkContext.broadcast(codes)))
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.select("a", "b").distinct())
    known = classes.select("cls", "id", "copies").join(counts, "cls", "left").join(roots, "id", "left")
    known = known.select("cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    out = names.join(known, "cls", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
