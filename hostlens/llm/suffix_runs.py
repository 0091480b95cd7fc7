"""Suffix-array dedup with a run-length index.

Which 200-byte strings start more than once? The corpus is cut where equal strings must be cut
alike: each window of 200 bytes belongs to the least 64-gram in it (by a hash, leftmost first), so a
run of neighbouring windows that belong to one 64-gram is a piece of at most 336 bytes, and equal
windows belong to equal 64-grams at equal offsets. Pieces whose 64-gram occurs once can hold no
repeat. The others are grouped by 64-gram, equal pieces being one with a multiplicity, and each task
builds the index of its groups: the Burrows-Wheeler transform, compressed to runs, with the suffix
positions and common-prefix lengths sampled at the run ends. Between two samples the length of the
longest match elsewhere falls by one at each byte, so the matching statistics of all pieces stream
from the samples; where they reach 200 bytes, the window repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, groups, run_starts, small_batches, utf8, written

GRAM = 64
#: A window's position in a chunk takes the low bits of its rank, so chunks stay shorter than this.
POSITION_BITS = 24
SEPARATOR = 0xFF  # in no UTF-8 text
_RNG = np.random.Generator(np.random.PCG64(20))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(0, 2**63, (6, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = _RNG.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = ["id", "mark"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _PIECE[7]
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each position."""
    h = _BYTE[data]
    for level, (a, b) in enumerate(_STEP):
        h = h[: -(1 << level)] * a + h[1 << level :] * b
    return _mixed(h)


def _stretch_hash(h: np.ndarray, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from lo to end (192 to 384 of them), from the hashes of the grams that cover them."""
    total = (end - lo).astype(np.uint64) * _PIECE[6]
    for k, at in enumerate((lo, lo + 64, lo + 128, end - 192, end - 128, end - 64)):
        total = total * _PIECE[k] + h[at]
    return _mixed(total)


def cut(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The pieces of texts: (text number, first window, last window, 64-gram's hash, piece's hash, where the 64-gram is in it).

    Windows are counted from the text's start. A text shorter than `length` has no piece.
    """
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    h = gram_hashes(data)
    rank = h & ~np.uint64((1 << POSITION_BITS) - 1) | np.arange(len(h), dtype=np.uint64)
    span, reach = length - GRAM + 1, 1
    while reach * 2 <= span:
        rank = np.minimum(rank[:-reach], rank[reach:])
        reach *= 2
    if reach < span:
        rank = np.minimum(rank[: len(rank) - (span - reach)], rank[span - reach :])
    owner = (rank & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    new = np.empty(len(owner), bool)
    new[0] = True
    np.not_equal(owner[1:], owner[:-1], out=new[1:])
    new[offsets[:-1][offsets[:-1] < len(new)]] = True
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(owner)) - 1
    text = np.searchsorted(offsets, lo, "right") - 1
    last = offsets[text + 1] - length
    hi = np.minimum(hi, last)
    fits = lo <= hi
    text, lo, hi = text[fits], lo[fits], hi[fits]
    return text, lo - offsets[text], hi - offsets[text], h[owner[lo]], _stretch_hash(h, lo, hi + length), owner[lo] - lo


def _cut_batch(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    room = (1 << POSITION_BITS) - 1
    for part, data, offsets in byte_chunks(batch, "bytes"):
        # A text longer than a chunk may be goes in stretches that overlap by a window less a byte.
        firsts = range(0, max(1, len(data) - length + 1), room - length) if len(data) > room else [0]
        for first in firsts:
            if len(data) > room:
                some = data[first : first + room - 1]
                text, lo, hi, gram, piece, at = cut(some, np.array([0, len(some)]), length)
                lo, hi = lo + first, hi + first
            else:
                text, lo, hi, gram, piece, at = cut(data, offsets, length)
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("mark").take(take), pa.array(gram.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(at.astype(np.int32))], ["id", "mark", "gram", "piece", "lo", "hi", "at"])


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of data in order, by prefix doubling; equal ones sort again only among themselves."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.empty(n, bool)
    first[:1] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=first[1:])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    depth = 8
    slots = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(slots):
        at = order[slots]
        pair = rank[at] * (n + 1) + rank[np.minimum(at + depth, n)] + 1
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[slots] = at
        new = np.empty(len(slots), bool)
        new[0] = True
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of equal bytes from positions a and b on."""
    n = len(data)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        same = data[x] == data[y]
        step = same
        for k in range(1, 8):
            if not same.any():
                break
            out[live] += step
            x, y = np.minimum(x + 1, n - 1), np.minimum(y + 1, n - 1)
            step = step & (data[x] == data[y]) & (a[live] + out[live] < n) & (b[live] + out[live] < n)
        out[live] += step
        live = live[step]
    return out


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of data, with samples at both ends of each run."""

    def __init__(self, data: np.ndarray):
        order = suffix_order(data)
        before = data[order - 1].astype(np.int16)
        before[order == 0] = 256  # nothing stands before the first byte
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.size = len(data)
        self.run_bytes = before[heads]
        self.run_lengths = np.diff(np.append(heads, len(data)))
        joints = common_prefixes(data, order[heads[1:] - 1], order[heads[1:]])
        self.head_at, self.head_match = order[heads], np.append(0, joints)
        self.end_at, self.end_match = order[np.append(heads[1:], len(data)) - 1], np.append(joints, 0)

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of the longest match that starts elsewhere in the data."""
        place = np.arange(self.size)
        best = np.zeros(self.size, np.int64)
        for at, match in ((self.head_at, self.head_match), (self.end_at, self.end_match)):
            reach = np.full(self.size, -1, np.int64)
            reach[at] = match + at
            known = np.maximum.accumulate(np.where(reach >= 0, place, 0))
            np.maximum(best, reach[known] - place, out=best)
        return best


def repeated_windows(pieces: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (piece number, first, last) of windows of distinct pieces that start elsewhere too.

    All windows of a piece with several copies do.
    """
    sizes = np.array([len(x) for x in pieces])
    data = np.frombuffer(bytes([SEPARATOR]).join([*pieces, b""]), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    left = starts[owner] + sizes[owner] - np.arange(len(data))
    hit = np.minimum(RunIndex(data).matching_statistics(), left) >= length
    hit |= (copies[owner] > 1) & (left >= length)
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    number = owner[first]
    return number, first - starts[number], last - starts[number]


def _index(length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["bucket"]):
            starts = [*run_starts(table, ["bucket"]), table.num_rows]
            i = 0
            while i < len(starts) - 1:  # whole groups, about 3000 pieces at a time
                j = max(i + 1, int(np.searchsorted(starts, starts[i] + 3000, "right")) - 1)
                part = table.slice(starts[i], starts[j] - starts[i])
                number, first, last = repeated_windows(part.column("bytes").to_pylist(), np.asarray(part.column("copies")), length)
                take = pa.array(number)
                yield pa.RecordBatch.from_arrays([part.column("gram").combine_chunks().take(take), part.column("sub").combine_chunks().take(take), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["gram", "sub", "first", "last"])
                i = j

    return of


def _split(length: int, step: int):
    """Blocks of at most `step` neighbouring windows of each piece, laid out from its 64-gram.

    sub is a hash of the block's bytes, core one of the bytes that all windows of such a block share,
    also where the piece has only some of them.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in byte_chunks(batch, "bytes"):
                h = gram_hashes(data)
                windows = np.diff(offsets) - length + 1
                owner = np.repeat(np.arange(len(windows)), windows)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
                block = (np.asarray(part.column("at"))[owner] - place) // step
                new = np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]))
                heads = np.flatnonzero(new)
                last = place[np.append(heads[1:], len(owner)) - 1]
                owner, first, block = owner[heads], place[heads], block[heads]
                lo, end = offsets[owner] + first, offsets[owner] + last + length
                gram = offsets[owner] + np.asarray(part.column("at"))[owner]
                core = _stretch_hash(h, gram - block * step, gram - (block * step + step - 1) + length)
                take = pa.array(owner)
                kept = [part.column(c).take(take) for c in ("gram", "piece", "copies")]
                base = np.asarray(part.column("base"))[owner] + first
                texts = [data[a:b].tobytes() for a, b in zip(lo.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(base.astype(np.int32)), pa.array((gram - lo).astype(np.int32)), pa.array(_stretch_hash(h, lo, end).view(np.int64)), pa.array(core.view(np.int64)), pa.array(texts, pa.binary())], ["gram", "piece", "copies", "base", "at", "sub", "core", "bytes"])

    return of


_PARTS = "gram long, piece long, copies long, base int, at int, sub long, core long, bytes binary"


def repeats(docs: DataFrame, length: int = 200, most: int = 1000) -> DataFrame:
    """Stretches (id, mark, start, end) of texts in which every byte is in a window that repeats.

    `docs` has (id, mark, bytes), id and mark naming a row (rows alike in both have equal bytes).
    Stretches of a row may overlap. A 64-gram with more than `most` distinct pieces is split: its
    pieces are cut into blocks of neighbouring windows that share 192 bytes, which go on by their own hash where the whole block
    repeats, and window by window where what its windows share repeats.
    """
    if not 192 <= length <= 256:
        raise ValueError("windows have 192 to 256 bytes")
    small_batches()

    def pieces() -> DataFrame:
        return docs.mapInArrow(lambda batches: (out for batch in batches for out in _cut_batch(batch, length)), "id long, mark long, gram long, piece long, lo int, hi int, at int")

    # Written, so that the join below reads it by an exchange of its own and a frequent 64-gram can be split.
    twice = written(pieces().groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "twice")
    found = written(pieces().join(twice, "gram", "left_semi"), "pieces")
    distinct = found.groupBy("gram", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("id", "mark", "lo", "hi", "at")).alias("one")).select("gram", "piece", "copies", "one.*")
    length_of = F.col("hi") - F.col("lo") + length
    held = distinct.join(docs, _KEY).select("gram", "piece", "copies", "at", F.substring("bytes", F.col("lo") + 1, length_of).alias("bytes"))
    held = written(held, "held")
    crowded = held.groupBy("gram").count().where(F.col("count") > most).select("gram")
    crowded = written(crowded, "crowded")
    subs = held.join(crowded, "gram", "left_anti").select("gram", F.col("gram").alias("bucket"), F.col("piece").alias("sub"), "copies", "bytes")
    placed = None
    if not crowded.isEmpty():
        blocks = written(held.join(crowded, "gram", "left_semi").withColumn("base", F.lit(0)).mapInArrow(_split(length, length - 191), _PARTS), "blocks")
        kinds = written(blocks.groupBy("gram", "core", "sub").agg(F.sum("copies").alias("copies"), *[F.min(c).alias(c) for c in ("piece", "base", "at", "bytes")]), "kinds")
        mixed = written(kinds.groupBy("gram", "core").count().where("count > 1").select("gram", "core"), "mixed")
        windows = written(kinds.join(mixed, ["gram", "core"], "left_semi").select("gram", "piece", "copies", "base", "at", "bytes").mapInArrow(_split(length, 1), _PARTS), "windows")
        again = windows.groupBy("gram", "sub").agg(F.sum("copies").alias("copies"), F.min("bytes").alias("bytes")).where("copies > 1")
        whole = kinds.where("copies > 1").select("gram", "sub", "copies", "bytes")
        single = windows.where("copies = 1").select("gram", "piece", "base", "sub").join(again.select("gram", "sub"), ["gram", "sub"], "left_semi")
        placed = written(blocks.select("gram", "piece", "base", "sub").join(whole.select("gram", "sub"), ["gram", "sub"], "left_semi").unionByName(single), "placed")
        more = whole.unionByName(again).withColumn("bucket", F.xxhash64("gram", "sub"))
        subs = subs.unionByName(more)
    runs = subs.repartition("bucket").sortWithinPartitions("bucket", "sub").mapInArrow(_index(length), "gram long, sub long, first int, last int")
    runs = written(runs, "runs")
    if placed is None:
        marks = runs.withColumnRenamed("sub", "piece")
    else:
        moved = placed.select("gram", "piece", "base", "sub").join(runs, ["gram", "sub"]).select("gram", "piece", (F.col("first") + F.col("base")).alias("first"), (F.col("last") + F.col("base")).alias("last"))
        marks = runs.withColumnRenamed("sub", "piece").join(crowded, "gram", "left_anti").unionByName(moved)
    return found.join(marks, ["gram", "piece"]).select("id", "mark", (F.col("lo") + F.col("first")).alias("start"), (F.col("lo") + F.col("last") + length).alias("end"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with (id, mark, bytes): the doc_id (null apart) and a hash of the text name a row."""
    text = utf8(F.col("text"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("mark"), text.alias("bytes"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _spans(docs: DataFrame, length: int) -> DataFrame:
    return repeats(_keyed(docs), length).groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _rest(text: bytes, spans) -> str | None:
    if spans is None:
        return None
    parts, last = [], 0
    for start, end in merged([(x["start"], x["end"]) for x in spans]):
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while start < end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(text[last:start])
        last = end
    return b"".join([*parts, text[last:]]).decode("utf-8", "replace")


def removed_bytes(docs: DataFrame, length: int = 200) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    spans are the maximal runs [start, end) of bytes covered by a string of `length` bytes that also
    starts anywhere else, in the same text or another. A null text is empty. Rows that repeat a whole
    document are each other's copies; a null doc_id stays null. An empty table gives no rows.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column("id").to_pylist(), batch.column("bytes").to_pylist(), batch.column("spans").to_pylist()):
                runs = merged([(x["start"], x["end"]) for x in spans or ()])
                digest, last = hashlib.sha256(), 0
                for start, end in runs:
                    digest.update(text[last:start])
                    last = end
                digest.update(text[last:])
                rows.append((None if doc_id == -(2**63) else doc_id, len(text), sum(e - s for s, e in runs), len(runs), digest.hexdigest(), [{"start": s, "end": e} for s, e in runs]))
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return _keyed(docs).join(_spans(docs, length), _KEY, "left").mapInArrow(of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """The documents less their repeated bytes; a character stays if any byte of it does.

    n_chars, where there is one, follows the text. A document of which nothing but blanks stays goes;
    one without a repeat stays as it is.
    """

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_rest(text, runs) for text, runs in zip(texts, spans)], dtype=object)

    spans = _spans(docs, length)
    names = [f"`{c}`" for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(utf8(F.col("text")), F.col("doc_id").isNull()).alias("mark"))
    joined = keyed.join(spans, _KEY, "left").withColumn("rest", F.when(F.col("spans").isNotNull(), rest(utf8(F.col("doc.text")), F.col("spans"))))
    joined = joined.where(F.col("rest").isNull() | (F.trim(F.col("rest")) != ""))

    def value(name: str) -> Column:
        old = F.col("doc").getField(name)
        if name == "text":
            return F.coalesce(F.col("rest"), old).alias(name)
        if name == "n_chars":
            return F.when(F.col("rest").isNotNull(), F.length("rest").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return joined.select(*[value(c) for c in docs.columns])
