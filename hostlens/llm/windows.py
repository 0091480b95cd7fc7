"""Substring dedup by Rabin-Karp hashes of every window of words.

Each window of 20 consecutive words has a hash of 64 bits, a polynomial of its words' hashes, which
prefix sums give for all windows at once. A second polynomial deals the windows out to buckets, so that
equal windows meet; a bucket counts them and keeps the earliest, the one with the smallest
(doc_id, start). All others are repeats. What a task has read is counted there first: of windows that
are equal in one flush only the earliest travels, so a frequent one costs a row of a flush, not a row of
each document. Windows travel packed, thousands to a row: hashes, runs of one document, starts. Repeats
go by document and stretch to where they merge into maximal intervals.

Two windows are taken for equal when both polynomials are: 64 bits and the bucket. With buckets of
about three million windows a window meets a false partner with a probability of 2e-13, at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_chunks, groups, small_batches, utf8, written

LENGTH = 20
#: Bytes of text that are hashed at once; a longer text goes in stretches that end at blanks.
STRETCH = 1 << 20
#: Windows that a task holds before it counts and sends them, and the most in a row.
FLUSH, ROW = 1 << 20, 1 << 10
#: Bytes of text whose windows are one bucket, about three million of them; a task holds one bucket at a time.
BUCKET = 16 << 20
#: Repeats of this many neighbouring starts merge in one place, so a long document is many places.
PLACE = 1 << 20
NO_ID = -(2**63)

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so they have inverses modulo 2**64
_RUNS = [("ids", np.int64), ("marks", np.int32), ("counts", np.int32)]
_ENTRIES = [("hashes", np.uint64), ("low", np.uint8), ("high", np.uint32)]
_SCHEMA = "bucket int, ids binary, marks binary, counts binary, hashes binary, low binary, high binary"


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    out = []
    for x in (base, pow(base, -1, 2**64)):
        all_x = np.full(n, x, np.uint64)
        all_x[0] = 1
        out.append(np.multiply.accumulate(all_x))
    return out[0], out[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word of texts that lie one after another, and the number of words of each text."""
    inside = ~_BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    first[starts] = inside[starts]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.concatenate(([0], np.cumsum(end - at))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
    digests = b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_pylist()))
    both = np.frombuffer(digests, np.uint64).reshape(-1, 2)[np.asarray(words.indices)]
    return both, np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])


def window_hashes(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the window from each word on; windows go from text to text, the caller takes those inside one."""
    out = []
    for k, base in enumerate(_BASES):
        power, inverse = _powers(base, STRETCH)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words[:, k] * power[: len(words)], dtype=np.uint64)))
        h = (sums[length:] - sums[:-length]) * inverse[: max(0, len(words) - length + 1)]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(32)))
    return out[0], out[1]


def stretches(data: np.ndarray, most: int = STRETCH) -> Iterator[np.ndarray]:
    """A text in pieces of about `most` bytes that end at blanks; a word that is longer stays whole."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data):
            blanks = np.flatnonzero(_BLANK[data[max(at, end - most) : end]])
            if len(blanks):
                end = max(at, end - most) + int(blanks[-1]) + 1
                break
            end = min(end + most, len(data))
        yield data[at:end]
        at = end


def _hashed(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, marks, windows, first start, hashes, second hashes) of pieces of texts."""
    for part, data, offsets in byte_chunks(batch, "bytes"):
        ids, marks = np.asarray(part.column("id")), np.asarray(part.column("mark"))
        if len(data) <= STRETCH:
            words, counts = word_hashes(data, offsets)
            n = np.maximum(counts - length + 1, 0)
            first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h, g = window_hashes(words, length) if len(words) >= length else (np.zeros(0, np.uint64),) * 2
            yield ids, marks, n, np.zeros(len(ids), np.int64), h[first], g[first]
            continue
        tail, start = np.zeros((0, 2), np.uint64), 0
        for piece in stretches(data):
            words, _ = word_hashes(piece, np.array([0, len(piece)]))
            words = np.concatenate((tail, words))
            if len(words) >= length:
                h, g = window_hashes(words, length)
                yield ids, marks, np.array([len(h)]), np.array([start]), h, g
                start += len(h)
            tail = words[max(0, len(words) - length + 1) :]


def _packed(bucket: np.ndarray, ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Rows of at most ROW entries of a bucket; entries are sorted by bucket and, in it, by document and start.

    A row has the runs of one document (id, mark, entries) and, of each entry, the hash and the step from
    the start before it, its low byte apart: the rest is nearly always 0 and all but vanishes when a
    shuffle is compressed.
    """
    n = len(bucket)
    new = np.append(True, bucket[1:] != bucket[:-1])[:n]
    heads = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
    row = np.flatnonzero(place % ROW == 0)
    run_new = np.append(True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]))[:n]
    run_new[row] = True
    run = np.flatnonzero(run_new)
    step = np.diff(starts, prepend=0)
    step[run] = starts[run]
    values = {"ids": ids[run], "marks": marks[run], "counts": np.diff(np.append(run, n)), "hashes": hashes, "low": step & 0xFF, "high": step >> 8}

    def column(name: str, kind: type, bounds: np.ndarray) -> pa.Array:
        raw = np.ascontiguousarray(values[name], kind)
        return pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])

    by_run, by_entry = np.searchsorted(run, np.append(row, n)), np.append(row, n)
    if not len(hashes):
        by_hash = np.zeros(len(row) + 1, np.int64)
    else:
        by_hash = by_entry
    arrays = [column(k, t, by_run) for k, t in _RUNS] + [column(k, t, by_hash if k == "hashes" else by_entry) for k, t in _ENTRIES]
    return pa.RecordBatch.from_arrays([pa.array(bucket[row].astype(np.int32)), *arrays], ["bucket", *(k for k, _ in _RUNS + _ENTRIES)])


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """(ids, marks, starts, hashes) of the entries of packed rows."""

    def flat(name: str, kind: type) -> np.ndarray:
        parts = []
        for x in rows.column(name).chunks:
            wide = pa.types.is_large_binary(x.type)
            at = np.frombuffer(x.buffers()[1], np.int64 if wide else np.int32, len(x) + 1 + x.offset)
            parts.append(np.frombuffer(x.buffers()[2] or b"", np.uint8)[at[x.offset] : at[-1]])
        return np.concatenate(parts).view(kind)

    counts = flat("counts", np.int32)
    step = (flat("high", np.uint32).astype(np.int64) << 8) | flat("low", np.uint8)
    total = np.cumsum(step)
    heads = np.cumsum(counts) - counts
    starts = total - np.repeat(total[heads] - step[heads], counts)
    return np.repeat(flat("ids", np.int64), counts), np.repeat(flat("marks", np.int32), counts), starts, flat("hashes", np.uint64)


def _places(ids: np.ndarray, starts: np.ndarray, buckets: int) -> np.ndarray:
    x = (ids.astype(np.uint64) * np.uint64(_BASES[0]) + (starts // PLACE).astype(np.uint64)) * np.uint64(_BASES[1])
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _repeats(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, buckets: int, shift: int) -> pa.RecordBatch:
    """Repeats, packed by the place where they merge; shift sets these buckets apart from those that count."""
    place = _places(ids, starts, buckets)
    by = np.lexsort((starts, marks, ids, place))
    return _packed(place[by] + shift, ids[by], marks[by], starts[by], np.zeros(0, np.uint64))


def _send(length: int, buckets: int, flush: int):
    """Windows of texts: the earliest of each in a flush by bucket, the others as repeats."""

    def emit(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, marks, n, first = (np.concatenate([x[k] for x in held]) for k in range(4))
        h, g = (np.concatenate([x[k] for x in held]) for k in (4, 5))
        if not len(h):
            return
        # Pieces in the order of (id, mark, start), and their windows with them.
        by = np.lexsort((first, marks, ids))
        begin, n, first = (np.cumsum(n) - n)[by], n[by], first[by]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        take = np.repeat(begin, n) + inner
        ids, marks, starts, h, g = np.repeat(ids[by], n), np.repeat(marks[by], n), np.repeat(first, n) + inner, h[take], g[take]
        order = np.argsort(h, kind="stable")
        same = np.append(False, (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]]))
        again = np.zeros(len(h), bool)
        again[order] = same
        if same.any():
            # Texts of one id are alike to (id, mark) but not to (id, start): the least start comes first.
            group = np.cumsum(~same) - 1
            some = np.flatnonzero(same | np.append(same[1:], False))
            at, which = order[some], group[some]
            inner = np.lexsort((starts[at], ids[at], which))
            at, which = at[inner], which[inner]
            head = np.append(True, which[1:] != which[:-1])
            lead = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
            alike = (ids[at] == ids[lead]) & (starts[at] == starts[lead])
            again[at] = ~head
            later = at[~alike]
            yield _repeats(ids[later], marks[later], starts[later], buckets, buckets)
            twins = at[alike & ~head]  # an equal window at the same place of a text of the same id: judged as its twin is
            again[twins] = marks[twins] == marks[lead[alike & ~head]]
        only = np.flatnonzero(~again)
        bucket = (g[only] % np.uint64(buckets)).astype(np.int64)
        only = only[np.argsort(bucket, kind="stable")]
        yield _packed((g[only] % np.uint64(buckets)).astype(np.int64), ids[only], marks[only], starts[only], h[only])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in _hashed(batch, length):
                held.append(x)
                size += len(x[4])
                if size >= flush:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return of


def _judge(buckets: int):
    """Counts each bucket's windows: all but the earliest of equal ones are repeats."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["bucket"]):
            for rows in _each(table):
                if rows.column("bucket")[0].as_py() >= buckets:
                    yield from rows.to_batches()
                    continue
                ids, marks, starts, h = _unpacked(rows)
                order = np.argsort(h)
                same = h[order[1:]] == h[order[:-1]]
                some = order[np.append(False, same) | np.append(same, False)]
                by = some[np.lexsort((starts[some], ids[some], h[some]))]
                if not len(by):
                    continue
                head = np.append(True, h[by[1:]] != h[by[:-1]])
                lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
                later = by[(ids[by] != ids[lead]) | (starts[by] != starts[lead])]
                if len(later):
                    yield _repeats(ids[later], marks[later], starts[later], buckets, buckets)

    return of


def _each(table: pa.Table) -> Iterator[pa.Table]:
    key = np.asarray(table.column("bucket"))
    cuts = [*np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)]
    for a, b in zip(cuts, cuts[1:]):
        yield table.slice(a, b - a)


def _merge(length: int):
    """Repeats of a place as maximal intervals of words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["bucket"]):
            for rows in _each(table):
                ids, marks, starts, _ = _unpacked(rows)
                by = np.lexsort((starts, marks, ids))
                ids, marks, starts = ids[by], marks[by], starts[by]
                new = np.append(True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (starts[1:] > starts[:-1] + length))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(ids)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(marks[first]), pa.array(starts[first]), pa.array(starts[last] + length)], ["id", "mark", "start", "end"])

    return of


def repeated_intervals(docs: DataFrame, length: int = LENGTH, flush: int = FLUSH, bucket: int = BUCKET) -> DataFrame:
    """Intervals (id, mark, start, end) of words that a repeated window covers; `docs` has (id, mark, bytes).

    A window repeats if an equal one has a smaller (id, start). Intervals of a row may touch where its
    places do. `flush` windows at a time are held by a task that sends, the windows of `bucket` bytes of
    text by one that counts (there are at least as many as shuffle partitions); on much larger data both may
    grow with the executors.
    """
    small_batches()
    size = docs.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket))
    sent = docs.mapInArrow(_send(length, buckets, flush), _SCHEMA)
    # A bucket is a task, and so is a place where repeats merge; places come after the buckets.
    judged = sent.repartitionById(2 * buckets, "bucket").mapInArrow(_judge(buckets), _SCHEMA)
    merged = judged.repartitionById(buckets, F.col("bucket") - buckets).mapInArrow(_merge(length), "id long, mark int, start long, end long")
    return written(merged, "repeats")


def _keyed(docs: DataFrame) -> DataFrame:
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id orders documents and must be an integer")
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.hash("text").alias("mark"), utf8(F.col("text")).alias("bytes"))


def _kept(text: memoryview | bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Words, removed words and the digest of the others, joined by one space."""
    digest, seen, removed, any_kept, k = hashlib.sha256(), 0, 0, False, 0
    for piece in stretches(np.frombuffer(text, np.uint8)):
        words = piece.tobytes().split()
        kept, at = [], 0
        while k < len(spans) and spans[k][0] < seen + len(words):
            start, end = max(spans[k][0] - seen, at), min(spans[k][1] - seen, len(words))
            kept += words[at:start]
            removed += max(0, end - start)
            at = max(at, end)
            if spans[k][1] > seen + len(words):
                break
            k += 1
        kept += words[at:]
        seen += len(words)
        if kept:
            digest.update(b" " * any_kept + b" ".join(kept))
            any_kept = True
    return seen, removed, digest.hexdigest()


def without_repeats(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256, and spans, the removed intervals of words.

    Words are runs of bytes other than blanks (0x20, 0x09 to 0x0D). Each word goes that is in a window of
    `length` words whose words also start earlier: in a smaller doc_id, or further on the left in the same
    one. Windows are judged on the input. A null text has no words; a null doc_id comes before all others;
    rows with one doc_id are one document to that order, so rows alike in doc_id and text are treated
    alike, and only what repeats elsewhere goes. Texts of fewer words than a window stay whole. Other
    columns don't matter. An empty table gives no rows.
    """
    keyed = _keyed(docs)
    found = repeated_intervals(keyed.select("id", "mark", "bytes"), length, **sizes)
    spans = found.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for text, found in zip(batch.column("bytes"), batch.column("spans").to_pylist()):
                runs = sorted((x["start"], x["end"]) for x in found or ())
                joined: list[tuple[int, int]] = []
                for start, end in runs:
                    if joined and start <= joined[-1][1]:
                        joined[-1] = joined[-1][0], max(end, joined[-1][1])
                    else:
                        joined.append((start, end))
                rows.append(_kept(text.as_buffer() or b"", joined))
                out.append([{"start": a, "end": b} for a, b in joined])
            words, removed, digests = zip(*rows) if rows else ((), (), ())
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(out, spans_type)], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.join(spans, ["id", "mark"], "left").select("doc_id", "bytes", "spans").mapInArrow(of, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>")
