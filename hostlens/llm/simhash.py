"""SimHash near-dedup by anchor points of a covering code.

A fingerprint is cut into words of up to 23 bits. The anchors of a word are the 4096 codewords of the
binary Golay code, which has exactly one codeword within 3 bits (its covering radius) of any word: the
word's home. A fingerprint stays at the homes of its words and visits all anchors within 3 bits plus what
two fingerprints may differ by in a word; those that stay are compared with those that visit, per anchor,
on all bits. With more fingerprints the anchors are products, of the codes of two or three words, so the
comparisons that each one takes stay bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups, run_starts, small_batches, utf8, written

#: Generator polynomial of the binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
COVERING_RADIUS = 3
#: Longer texts are gone through in stretches of so many bytes.
STRETCH = 1_000_000
_BLANK = re.compile(rb"[ \t-\r]")


@dataclass(frozen=True)
class Level:
    """Anchors for up to `most` fingerprints: products of words' codes, and by how many bits beyond the radius a visit may be in each word."""

    most: float
    words: tuple[tuple[int, ...], ...]
    beyond: tuple[tuple[int, ...], ...]


@dataclass(frozen=True)
class Layout:
    """Fingerprints of `lanes` times 64 bits over shingles of `width` words, linked within `threshold` bits; words are (lane, lowest bit, bits)."""

    width: int
    lanes: int
    threshold: int
    words: tuple[tuple[int, int, int], ...]
    levels: tuple[Level, ...]

    def level(self, classes: int) -> Level:
        return next(x for x in self.levels if classes <= x.most)


_SUMS_TO_4 = tuple((a, b, c) for a in range(5) for b in range(5 - a) for c in range(5 - a - b))

#: Four bits of 64. Of three words one differs by at most 1 bit; two neighbours by (0, 2) or (1, 1) at most; all by 4.
FOUR_BITS = Layout(
    4, 1, 4, ((0, 0, 22), (0, 22, 21), (0, 43, 21)),
    (
        Level(2**22, ((0,), (1,), (2,)), ((0,), (1,))),
        Level(2**36, ((0, 1), (1, 2), (2, 0)), ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2))),
        Level(float("inf"), ((0, 1, 2),), _SUMS_TO_4),
    ),
)

#: A similarity of five-word shingles of 0.8: there 39 of 256 bits differ in the mean, and 46 or fewer nine times of ten.
#: Such pairs meet at an anchor of some word with a probability of 0.98, nearer pairs more often. Products of words would
#: meet 0.6 of them (measured), so there is one level, and the comparisons of a fingerprint are 0.01 of the number of all.
SIMILAR = Layout(
    5, 4, 46, tuple((lane, low, 23) for lane in range(4) for low in (0, 23)),
    (Level(float("inf"), tuple((w,) for w in range(8)), ((0,), (1,))),),
)


def _shingles(text: bytes, width: int) -> Iterator[list[bytes]]:
    """Lists of space-joined shingles of the text's words; a text of fewer words is one shingle, one without words has none."""
    tail: list[bytes] = []
    at, any_ = 0, False
    while at < len(text):
        end = len(text)
        if at + STRETCH < end:
            blank = _BLANK.search(text, at + STRETCH)
            end = blank.start() if blank else end
        words = tail + text[at:end].lower().split()
        at, tail = end, words[max(0, len(words) - width + 1) :]
        if len(words) < width:
            continue
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[: -width] + 1)) if width == 1 else np.concatenate(([0], ends[:-1] + 1))[: 1 - width]
        any_ = True
        yield [line[s:e] for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())]
    if tail and not any_:
        yield [b" ".join(tail)]


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Hashes as rows of `lanes` words: the hash itself, and mixes of it."""
    out = np.empty((len(hashes), lanes), "<u8")
    out[:, 0] = hashes
    for k in range(1, lanes):
        h = (hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        out[:, k] = h ^ h >> np.uint64(32)
    return out


def fingerprint(text: bytes, width: int = 4, lanes: int = 1) -> np.ndarray:
    """The majority of each bit over the XXH64 (seed 42) of the text's word shingles; further lanes over mixes of it."""
    counts, total = np.zeros(64 * lanes, np.int64), 0
    for shingles in _shingles(text, width):
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8", len(shingles))
        total += len(hashes)
        for i in range(0, len(hashes), 255 * 16):
            part = _lanes(hashes[i : i + 255 * 16], lanes)
            bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255  # so many ones fit a byte
            counts += bits[:whole].reshape(-1, 255, 64 * lanes).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > total, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, layout: Layout = FOUR_BITS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of all documents and fp, the fingerprint: a signed long, or bytes if it has several lanes."""
    small_batches()
    names, lanes = list(carry), layout.lanes

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(x.as_py(), layout.width, lanes) for x in batch.column("bytes")]
            fp = pa.array(np.concatenate([np.zeros(0, np.uint64), *marks]).view(np.int64)) if lanes == 1 else pa.array([m.tobytes() for m in marks], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], fp], [*names, "fp"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    return docs.select(*names, utf8(F.col("text")).alias("bytes")).mapInArrow(of, ", ".join([*kinds, "fp long" if lanes == 1 else "fp binary"]))


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def _steps(beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the differences that lead a word to a codeword: the one within the radius, or those of `beyond` more bits.

    Returns the differences ordered by syndrome and where each syndrome's part starts.
    """
    layers = [np.zeros(1, np.int64)]
    for _ in range(COVERING_RADIUS + beyond):
        layer = layers[-1]
        layers.append(np.unique((layer[:, None] | (1 << np.arange(23))[None, :])[(layer[:, None] >> np.arange(23)[None, :] & 1) == 0]))
    steps = layers[-1] if beyond else np.concatenate(layers)
    of = _syndromes(steps)
    order = np.argsort(of, kind="stable")
    return steps[order], np.searchsorted(of[order], np.arange(2049))


class Anchors:
    """The anchors of a level for fingerprints as rows of lanes."""

    def __init__(self, layout: Layout, level: Level):
        self.layout, self.level = layout, level
        self.steps = [_steps(e) for e in range(1 + max(max(b) for b in level.beyond))]

    def of(self, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(anchor keys, rows of the fingerprints, whether these are the homes) by product of words and distance."""
        words = [(marks[:, lane] >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for lane, low, width in self.layout.words]
        kinds = [_syndromes(w) for w in words]
        for number, mine in enumerate(self.level.words):
            for beyond in self.level.beyond:
                owner, key = np.arange(len(marks)), np.full(len(marks), number)
                for w, e in zip(mine, beyond):
                    steps, starts = self.steps[e]
                    kind = kinds[w][owner]
                    n = starts[kind + 1] - starts[kind]
                    at = np.repeat(starts[kind] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    owner, key = np.repeat(owner, n), np.repeat(key, n)
                    # The upper 12 bits of a codeword tell it from the others.
                    key = key << 12 | (words[w][owner] ^ steps[at]) >> 11
                yield key, owner, not any(beyond)


def _near(left: np.ndarray, right: np.ndarray, threshold: int) -> np.ndarray:
    """Which rows of lanes differ, by at most the threshold."""
    bits = sum(np.bitwise_count(left[:, None, k] ^ right[None, :, k]).astype(np.uint16) for k in range(left.shape[1]))
    return (bits <= threshold) & (bits > 0)


def near_edges(homes: np.ndarray, visits: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of two arrays of distinct fingerprints, as numbers of rows (visits after homes), that connect all within the threshold.

    Sparse groups give every link. In a dense group a fingerprint that is reached is not reached
    again, so at most one link for each leaves, and the work shrinks with what is left.
    """
    left, right, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i in range(0, len(homes), 256):
        for j in range(0, len(visits), 2048):
            rows, cols = np.nonzero(_near(homes[i : i + 256], visits[j : j + 2048], threshold))
            left.append(rows + i)
            right.append(cols + j + len(homes))
            found += len(rows)
        if found > 4 * (len(homes) + len(visits)) + 64:
            return _tree_edges(np.concatenate((homes, visits)), threshold)
    return np.concatenate(left), np.concatenate(right)


def _tree_edges(marks: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest, todo = np.arange(len(marks)), []
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
        x = todo.pop()
        bits = sum(np.bitwise_count(marks[rest, k] ^ marks[x, k]).astype(np.uint16) for k in range(marks.shape[1]))
        near = bits <= threshold
        if near.any():
            hits = rest[near]
            rest = rest[~near]
            todo.extend(hits.tolist())
            left.append(np.full(len(hits), x))
            right.append(hits)
    return np.concatenate(left), np.concatenate(right)


def links(classes: DataFrame, layout: Layout = FOUR_BITS, level: Level | None = None, most: int = 4096) -> DataFrame:
    """Links (a, b) between the nodes of `classes` (node; fp too if it has several lanes) that connect all fingerprints found within the threshold.

    Without several lanes the node is the fingerprint. An anchor with more than `most` visits, or homes,
    is cut into parts, and each part of the homes meets each of the visits in a cell of its own, so no task
    gets an anchor whole.
    """
    several, threshold = layout.lanes > 1, layout.threshold
    carried = ["node", "fp"] if several else ["node"]
    level = level or layout.level(classes.count())
    chunk = 20_000 if len(level.words[0]) == 1 else 1000 if len(level.words[0]) == 2 else 20

    def marks_of(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        if several:
            return np.frombuffer(b"".join(rows.column("fp").to_pylist()), "<u8").reshape(-1, layout.lanes)
        return np.array(rows.column("node")).view(np.uint64).reshape(-1, 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(layout, level)
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                for keys, owners, home in anchors.of(marks_of(part)):
                    take = pa.array(owners)
                    # Homes are visited too.
                    for role in (1, 0) if home else (0,):
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), role, np.int32)), *[part.column(c).take(take) for c in carried]], ["anchor", "home", *carried])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["anchor", "cell"]):
            marks, home, node = marks_of(table), np.asarray(table.column("home")), np.asarray(table.column("node"))
            starts = [*run_starts(table, ["anchor", "cell"]).tolist(), len(marks)]
            out = []
            for i, j in zip(starts, starts[1:]):
                n = int(home[i:j].sum())  # homes come first
                if n and j - i > 2:
                    a, b = near_edges(marks[i : i + n], marks[i + n : j], threshold)
                    out.append((node[i:j][a], node[i:j][b]))
            if out:
                a, b = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    kinds = "node long, fp binary" if several else "node long"
    rows = classes.select(*carried).mapInArrow(spread, f"anchor long, home int, {kinds}")
    sizes = rows.groupBy("anchor").agg(F.sum("home").alias("homes"), F.sum(1 - F.col("home")).alias("visits"))
    large = sizes.where((F.col("homes") > most) | (F.col("visits") > most)).select("anchor", F.ceil(F.col("homes") / most).alias("h"), F.ceil(F.col("visits") / most).alias("v"))
    large = written(large, "large")
    rows = rows.join(large, "anchor", "left").withColumns({"h": F.coalesce("h", F.lit(1)), "v": F.coalesce("v", F.lit(1)), "draw": F.xxhash64("node", F.lit(7))})
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    at_home = F.transform(to("v"), lambda j: F.pmod("draw", "h") * F.col("v") + j)
    visiting = F.transform(to("h"), lambda j: j * F.col("v") + F.pmod("draw", "v"))
    cells = F.when((F.col("h") <= 1) & (F.col("v") <= 1), F.array(F.lit(0).cast("long"))).when(F.col("home") == 1, at_home).otherwise(visiting)
    dealt = rows.select("anchor", "home", *carried, F.explode(cells).alias("cell")).repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", F.desc("home"), "node")
    found = dealt.mapInArrow(compare, "a long, b long").where("a <> b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rooted(classes: DataFrame, layout: Layout) -> DataFrame:
    """`classes` (node, and fp if it has several lanes) with the root of each one's component."""
    roots = components(links(classes, layout)).withColumnRenamed("id", "node")
    return classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id (as long), fp (long), fingerprint (hex), component_id, kept.

    component_id is the smallest doc_id reachable by links of at most four of 64 bits over four-word
    shingles; copies of one fingerprint are one node. A null or blank text has fingerprint zero and links
    like any other; very long texts are gone through in stretches. A null doc_id gets its fingerprint's
    component but never names one; a component with null ids only has a null component_id. Rows that
    repeat a doc_id each stay. kept holds for the row whose doc_id names its component, and for rows of a
    component without an id. An empty table gives no rows.
    """
    marks = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "fingerprints")
    classes = written(marks.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least_id")), "classes")
    named = written(_rooted(classes, FOUR_BITS), "rooted")
    # Written, so that a root with very many fingerprints is split by the skew join.
    names = written(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "names")
    named = named.join(names, "root").select(F.col("node").alias("fp"), "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def kept_documents(docs: DataFrame, layout: Layout = SIMILAR) -> DataFrame:
    """One row of `docs` for each near-duplicate group: of the smallest doc_id (null last), of these the one whose columns hash least.

    Texts are in one group if links connect them: fingerprints within the layout's threshold, by default
    the estimate of a similarity of 0.8 over five-word shingles. Texts without words are one group. Of rows
    that are alike in all columns one stays. doc_id may be of any type that has an order.
    """
    columns = [F.col(f"doc.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"))
    keyed = keyed.select("doc", F.col("doc.doc_id").alias("doc_id"), F.xxhash64(*columns, *[c.isNull() for c in columns]).alias("row"))
    marks = fingerprints(keyed.select("doc_id", "row", "doc.text"), layout, ("doc_id", "row"))
    # A fingerprint's rows are reduced first, so a component has few rows left to group.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("one")
    classes = written(marks.groupBy("fp").agg(one).withColumn("node", F.monotonically_increasing_id() if layout.lanes > 1 else F.col("fp")), "classes")
    least = _rooted(classes, layout).groupBy("root").agg(F.min("one").alias("one"))
    keep = written(least.select("one.doc_id", "one.row"), "keep")
    several = written(keyed.groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row"), "several")

    def picked(keys: DataFrame, how: str, by: DataFrame) -> DataFrame:
        return keys.join(by, keys["doc_id"].eqNullSafe(by["doc_id"]) & (keys["row"] == by["row"]), how)

    if several.isEmpty():
        return picked(keyed, "left_semi", keep).select("doc.*")
    alone = picked(keyed, "left_semi", picked(keep, "left_anti", several))
    alike = picked(keyed, "left_semi", picked(keep, "left_semi", several)).dropDuplicates(["doc_id", "row"])
    return alone.union(alike).select("doc.*")
