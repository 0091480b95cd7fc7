"""Benchmark decontamination by the q-gram lemma.

A benchmark item is cut into windows of 64 normalised bytes, one at every 16th byte and one at its end, so
that any quote of 79 of an item's bytes holds a window whole. A stretch of a document within k edits of a
window of m bytes shares at least m - q + 1 - q k of its q-grams, on diagonals at most k apart. So shared
q-grams are counted in bands of diagonals, each overlapping the next by half; bands that meet the bound
are verified by an alignment inside the band. Items too short for that are matched as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, small_batches, utf8, written
from .langid import chunks, joined

Q = 10
WINDOW = 64
STRIDE = 16
EDIT_SHARE = 0.08
#: Items of fewer normalised bytes are matched whole, without edits and between word boundaries.
SHORT = 24
#: Bytes of items that one index holds; it has about 60 times as many.
BLOCK_BYTES = 1_000_000
#: Longer texts are gone through in stretches of so many bytes.
STRETCH = 1_000_000
#: About so many shared q-grams are held at once.
MOST_HITS = 2_000_000
#: The q-grams of a stretch within the budget of a window start within so many bytes.
REACH = WINDOW + int(WINDOW * EDIT_SHARE)
_FLAG_BITS = 22
_SPACE = 32
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _SPACE for b in range(256)], np.uint8)
_RNG = np.random.Generator(np.random.PCG64(9))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(0, 2**63, (4, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RESULT = "array<struct<item:int,start:int,end:int,windows:int,edits:int>>"
#: Bits of a key of a shared q-gram: place in the window, band, window; the text takes the rest.
_PLACE_BITS, _BAND_BITS, _WINDOW_BITS = 6, 22, 24


def normalised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with runs of others than letters and digits as one space; where texts start; where each byte was."""
    data, offsets = joined(texts)
    folded = _FOLD[data]
    keep = folded != _SPACE
    keep[1:] |= folded[:-1] != _SPACE
    keep[offsets[:-1][offsets[:-1] < len(keep)]] = True
    place = np.flatnonzero(keep)
    return folded[place], np.searchsorted(place, offsets), place


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ten bytes from each position."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    one = _BYTE[data]
    two = one[:-1] * _STEP[0, 0] + one[1:] * _STEP[0, 1]
    four = two[:-2] * _STEP[1, 0] + two[2:] * _STEP[1, 1]
    eight = four[:-4] * _STEP[2, 0] + four[4:] * _STEP[2, 1]
    h = eight[: len(data) - Q + 1] * _STEP[3, 0] + two[8 : 8 + len(data) - Q + 1] * _STEP[3, 1]
    h ^= h >> np.uint64(32)
    return h * _BYTE[0]


@dataclass
class Index:
    """The distinct windows of a block of items with the items that have each, and their q-grams by hash (then window)."""

    windows: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    owners: list[list[int]]
    hashes: np.ndarray
    window: np.ndarray
    place: np.ndarray
    short: dict[bytes, list[int]]

    @property
    def least(self) -> np.ndarray:
        """Places of a window whose q-grams a stretch within its budget shares; above 0 for any window."""
        return self.size - Q + 1 - Q * self.edits

    def flags(self) -> np.ndarray:
        seen = np.zeros(1 << _FLAG_BITS, bool)
        seen[(self.hashes >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)] = True
        return seen

    def exact(self) -> ahocorasick.Automaton | None:
        """Finds the short items, each between spaces, in Latin-1 text."""
        if not self.short:
            return None
        words = ahocorasick.Automaton()
        for text, items in self.short.items():
            words.add_word(f" {text.decode('latin-1')} ", (len(text), items))
        words.make_automaton()
        return words


def build(texts: list[bytes]) -> Index:
    """The windows of each item; an item shorter than a window is one. The edit budget is 8 %, and less where no q-gram would be left."""
    numbers: dict[bytes, int] = {}
    owners: list[list[int]] = []
    short: dict[bytes, list[int]] = {}
    for item, text in enumerate(texts):
        data = normalised([text])[0].tobytes().strip(b" ")
        if 0 < len(data) < SHORT:
            short.setdefault(data, []).append(item)
        if len(data) < SHORT:
            continue
        last = max(0, len(data) - WINDOW)
        for start in [*range(0, last, STRIDE), last]:
            number = numbers.setdefault(data[start : start + WINDOW], len(numbers))
            if number == len(owners):
                owners.append([])
            if not owners[number] or owners[number][-1] != item:
                owners[number].append(item)
    if len(numbers) >= 1 << _WINDOW_BITS:
        raise ValueError("an item has more windows than an index can number")
    windows = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in numbers), np.uint8).reshape(-1, WINDOW)
    size = np.array([len(w) for w in numbers], np.int64)
    edits = np.minimum((size * EDIT_SHARE).astype(np.int64), (size - Q) // Q)
    window = np.repeat(np.arange(len(size)), size - Q + 1)
    place = np.arange(len(window)) - np.repeat(np.cumsum(size - Q + 1) - (size - Q + 1), size - Q + 1)
    hashes = gram_hashes(windows.ravel())[window * WINDOW + place] if len(size) else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    return Index(windows, size, edits, owners, hashes[order], window[order].astype(np.int32), place[order].astype(np.int8), short)


def _edits(index: Index, data: np.ndarray, window: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least edits of each window against data on the diagonals of its band, within [start, end)."""
    out = np.zeros(len(window), np.int64)
    size = index.size[window]
    for m in np.unique(size).tolist():
        rows = np.flatnonzero(size == m)
        k = int(index.edits[window[rows[0]]])
        across = np.arange(2 * (k + 1))
        for pick in np.array_split(rows, -(-len(rows) // 4096)):
            chars = index.windows[window[pick]]
            cost = np.zeros((len(pick), len(across)), np.int32)
            for i in range(m):
                at = low[pick, None] + across[None] + i
                inside = (at >= start[pick, None]) & (at < end[pick, None])
                same = inside & (data[np.clip(at, 0, len(data) - 1)] == chars[:, i : i + 1])
                step = cost + ~same
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(step - across[None].astype(np.int32), axis=1) + across[None].astype(np.int32)
            out[pick] = cost.min(1)
    return out


def _pieces(at: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of positions with about MOST_HITS shared q-grams each; neighbours overlap by what one window may span."""
    total, i = np.cumsum(n), 0
    while i < len(at):
        full = int(np.searchsorted(total, (total[i - 1] if i else 0) + MOST_HITS, "right"))
        j = max(full, int(np.searchsorted(at, at[i] + 4 * REACH)))
        yield i, j
        if j >= len(at):
            return
        i = int(np.searchsorted(at, at[j] - REACH))


def _entries(index: Index, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranges of the index for each position; where they are too many together, those of a range of windows at a time."""
    parts = int((right - left).sum()) // (2 * MOST_HITS) + 1
    if parts == 1:
        yield left, right
        return
    cuts = np.linspace(0, len(index.size), parts + 1).astype(int)
    bounds = np.array([a + np.searchsorted(index.window[a:b], cuts) for a, b in zip(left.tolist(), right.tolist())])
    for p in range(parts):
        yield bounds[:, p], bounds[:, p + 1]


def _candidates(index: Index, h: np.ndarray, at: np.ndarray, text: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, window, least diagonal) of the bands that share enough q-grams with a window."""
    left, right = np.searchsorted(index.hashes, h, "left"), np.searchsorted(index.hashes, h, "right")
    for i, j in _pieces(at, right - left):
        for a, b in _entries(index, left[i:j], right[i:j]):
            n = b - a
            entry = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            window, place = index.window[entry].astype(np.int64), index.place[entry].astype(np.int64)
            t = np.repeat(text[i:j], n)
            band = (np.repeat(at[i:j], n) - place - first[t] + WINDOW) // (index.edits[window] + 1) + 1
            key = ((t << _WINDOW_BITS | window) << _BAND_BITS | band) << _PLACE_BITS | place
            # Each diagonal is in two bands.
            key = np.sort(np.concatenate((key, key - (1 << _PLACE_BITS))))
            key = key[np.append(True, key[1:] != key[:-1])[: len(key)]] >> _PLACE_BITS
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            shared = np.diff(np.append(head, len(key)))
            key = key[head]
            window = key >> _BAND_BITS & (1 << _WINDOW_BITS) - 1
            enough = shared >= index.least[window]
            key, window = key[enough], window[enough]
            band, t = (key & (1 << _BAND_BITS) - 1) - 1, key >> _BAND_BITS + _WINDOW_BITS
            yield t, window, band * (index.edits[window] + 1) - WINDOW


class Finder:
    """An index with what is looked up in it, for one worker."""

    def __init__(self, index: Index):
        self.index, self.flags, self.words = index, index.flags(), index.exact()

    def _in(self, data: np.ndarray, first: np.ndarray, place: np.ndarray, rows: list[dict[int, dict]], opens: bool = True, closes: bool = True) -> None:
        """Adds what is found in normalised texts to the rows (item -> row) of each; place has where bytes were in their text.

        A stretch that does not open its text may start inside a word, one that does not close it may end inside one.
        """
        if self.words is not None:
            for t in range(len(rows)):
                at = place[first[t] : first[t + 1]]
                for end, (size, items) in self.words.iter(" " * opens + data[first[t] : first[t + 1]].tobytes().decode("latin-1") + " " * closes):
                    for item in items:
                        _add(rows[t], item, int(at[end - opens - size]), int(at[end - opens - 1]) + 1, 0, None)
        if not len(self.index.hashes) or len(data) < Q:
            return
        h = gram_hashes(data)
        at = np.flatnonzero(self.flags[(h >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)])
        text = np.searchsorted(first, at, "right") - 1
        inside = at + Q <= first[text + 1]
        at, text = at[inside], text[inside]
        for t, window, low in _candidates(self.index, h[at], at, text, first):
            if not len(t):
                continue
            edits = _edits(self.index, data, window, low + first[t], first[t], first[t + 1])
            good = edits <= self.index.edits[window]
            for t_, w, lo, e in zip(t[good].tolist(), window[good].tolist(), low[good].tolist(), edits[good].tolist()):
                begin = place[min(first[t_] + max(lo, 0), first[t_ + 1] - 1)]
                end = place[min(first[t_] + max(lo + int(self.index.size[w]) + 2 * int(self.index.edits[w]), 0), first[t_ + 1] - 1)] + 1
                for item in self.index.owners[w]:
                    _add(rows[t_], item, int(begin), int(end), e, w)

    def found(self, texts: list[bytes]) -> list[list[dict]]:
        """Per text the items found: item, start and end (bytes of the text), windows found, least edits."""
        rows: list[dict[int, dict]] = [{} for _ in texts]
        if len(texts) == 1 and len(texts[0]) > STRETCH:
            tail, where = np.zeros(0, np.uint8), np.zeros(0, np.int64)
            for begin in range(0, len(texts[0]), STRETCH):
                data, _, place = normalised([texts[0][begin : begin + STRETCH]])
                again = int(len(tail) > 0 and tail[-1] == _SPACE and data[0] == _SPACE)
                data, place = np.concatenate((tail, data[again:])), np.concatenate((where, place[again:] + begin))
                self._in(data, np.array([0, len(data)]), place, rows, begin == 0, begin + STRETCH >= len(texts[0]))
                tail, where = data[-2 * REACH :], place[-2 * REACH :]
        else:
            data, first, place = normalised(texts)
            self._in(data, first, place - np.repeat(np.cumsum([len(t) for t in texts]) - [len(t) for t in texts], np.diff(first)), rows)
        return [[{**row, "windows": len(row["windows"])} for _, row in sorted(r.items())] for r in rows]


def _add(rows: dict[int, dict], item: int, start: int, end: int, edits: int, window: int | None) -> None:
    row = rows.setdefault(item, {"item": item, "start": start, "end": end, "windows": set(), "edits": edits})
    row["start"], row["end"], row["edits"] = min(row["start"], start), max(row["end"], end), min(row["edits"], edits)
    row["windows"].add(window)


def blocks(benchmark: DataFrame) -> Iterator[tuple[Broadcast, DataFrame, bool]]:
    """For each block of about 1 MB of items its index, broadcast, rows (item, item_id), and whether it is the last; null texts are skipped.

    One block is on the driver at a time, and is unpersisted when the next is asked for, so what comes of
    all but the last must be written by then.
    """
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_BYTES))
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", benchmark.schema["item_id"].dataType)])
    for block in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(build([r["text"].encode() for r in part]))
        yield index, spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)], schema), block == count - 1
        index.unpersist()


def hits(text: Column, index: Broadcast) -> Column:
    small_batches()

    @F.pandas_udf(_RESULT)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(index.value)
        for batch in batches:
            yield pd.Series([x for part in chunks(list(batch)) for x in finder.found(part)], dtype=object)

    return of(utf8(text))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, start, end, windows, edits), one for each item found in a row of docs.

    A quote of at least 79 normalised bytes of an item is found at every offset, as is a shorter one that
    holds a window (64 bytes at every 16th and at the end), each with up to 8 % edits; of an item of 24 to
    64 bytes the whole is looked for. Shorter items are found without edits, as whole words; an item
    without a letter or digit is not looked for. start and end are the bytes of the text between which
    windows were found (a few more on each side, up to the edit budget), windows the number of different
    windows, edits the least of any. Null texts hold nothing; items alike are each found. Very long texts
    are gone through in stretches. Documents are read once for each 1 MB of items.
    """
    out = None
    for index, items, last in blocks(benchmark):
        rows = docs.select("doc_id", F.explode(hits(F.col("text"), index)).alias("hit")).withColumn("item", F.col("hit.item"))
        rows = rows.join(F.broadcast(items), "item").select("doc_id", "item_id", "hit.start", "hit.end", "hit.windows", "hit.edits")
        rows = rows if last else written(rows, "matches")
        out = rows if out is None else out.union(rows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, as they are."""
    rows, before = docs, None
    for index, _, last in blocks(benchmark):
        packed = rows.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"))
        packed = packed.where(F.size(hits(F.col("doc.text"), index)) == 0)
        rows = packed.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
        if not last:
            rows = written(rows, "clean")
            if before is not None:
                dropped(before)
            before = rows
    return rows
