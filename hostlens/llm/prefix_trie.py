"""Conversation prefix trie in balanced parentheses.

Conversations are paths of turns, a digest of 16 bytes for each turn. Equal paths are one with its
members; distinct paths are range-sorted, so those under one node of the trie are neighbours, and cut
into shards of bounded size. A shard writes its part of the trie as parentheses in preorder. The least
excess of blocks, and of pairs of blocks above them, finds the closing parenthesis of each node, and with
it the node's subtree: ranks of "()" count its leaves, differences of cumulative arrays its members and
savings, a range minimum its smallest member. The nodes on the first and the last path of a shard, its
spines, may go on in other shards; only these are merged, by a digest of their path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Turns after which a shard ends, with the path that it is at.
SHARD = 1 << 19
#: Parentheses in a block of least excess.
BLOCK = 64
#: Bytes of ids in a row that goes to where they are digested.
PIECE = 1 << 16
FAR = np.int64(2**63 - 1)


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order, null first, those of one number by role and digest; each a digest of role and text and the text's bytes."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), key.alias("key"), F.octet_length(text).alias("bytes")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations that start as the first of their family does: its first h turns, then their own after the first h.

    A family is `family` neighbouring ids, h the CRC-32 of the id, in decimal, modulo `most`.
    """
    heads = turns.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    c = F.col("conv_id")
    rows = turns.withColumns({"base": c - c % family, "h": (F.crc32(c.cast("string")) % most).cast("int")}).join(heads, "base", "left")
    none = F.lit([]).cast("array<struct<key:string,bytes:int>>")
    first = F.when(F.col("head").isNull() | (F.col("h") == 0), none).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.when(F.size("turns") <= F.col("h"), none).otherwise(F.slice("turns", F.col("h") + 1, F.size("turns")))
    return rows.select("conv_id", F.concat(first, rest).alias("turns"))


def _packed_path(turns: Column) -> list[Column]:
    return [F.unhex(F.array_join(F.transform(turns, lambda t: t["key"]), "")).alias("path"), F.transform(turns, lambda t: t["bytes"]).alias("sizes")]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, conv_id) as rows (digest, first id, members, their decimals joined by commas)."""
    held, digest, size = [], None, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([held[0]], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([",".join(map(str, held)).encode()], pa.binary())], ["digest", "first", "n", "ids"])

    for batch in batches:
        for key, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (key != digest or size >= PIECE):
                yield row()
                held, size = [], 0
            digest = key
            held.append(conv)
            size += 20
    if held:
        yield row()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as a row for each path: smallest member, members, digest of their ids."""
    now, first, n, ends = None, 0, 0, hashlib.sha256()
    for batch in batches:
        rows = []
        for key, conv, more, ids in zip(*(batch.column(c).to_pylist() for c in ("digest", "first", "n", "ids"))):
            if key != now:
                if now is not None:
                    rows.append((first, n, ends.hexdigest()))
                now, first, n, ends = key, conv, 0, hashlib.sha256(ids)
            else:
                ends.update(b"," + ids)
            n += more
        yield _ends(rows)
    if now is not None:
        yield _ends([(first, n, ends.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "n", "ends"])


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """Distinct paths (path, sizes, conv_id, n, ends) of conversations (conv_id, turns): the smallest member, the number of members, the digest of their ids.

    Members are range-sorted and packed before they meet, so those of a path that very many
    conversations have are read as a few rows, one after another.
    """
    rows = written(conversations.select("conv_id", *_packed_path(F.col("turns"))), "paths")
    members = rows.select(F.sha2("path", 256).alias("digest"), "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = members.mapInArrow(_pieces, "digest string, first long, n long, ids binary").repartition("digest").sortWithinPartitions("digest", "first")
    return rows.join(pieces.mapInArrow(_digested, "conv_id long, n long, ends string"), "conv_id")


def close_of(excess: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The closing parenthesis of each open one: the first place after it whose excess is lower.

    Least excesses of blocks, of pairs of blocks, and so on, are climbed until a range on the right holds
    a lower one, and walked down again; then the block is searched.
    """
    n = len(excess)
    blocks = -(-n // BLOCK)
    size = 1 << max(0, (blocks - 1).bit_length())
    padded = np.full(size * BLOCK, FAR)
    padded[:n] = excess
    levels = [padded.reshape(size, BLOCK).min(axis=1)]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).min(axis=1))
    want = excess[opens] - 1
    out = np.full(len(opens), -1)

    def search(which: np.ndarray, block: np.ndarray, after: np.ndarray) -> None:
        """The first place after `after` in each block with the wanted excess, where there is one."""
        for start in range(0, len(which), 1 << 15):
            w, b, a = (x[start : start + (1 << 15)] for x in (which, block, after))
            at = b[:, None] * BLOCK + np.arange(BLOCK)
            hit = (padded[at] <= want[w][:, None]) & (at > a[:, None])
            found = hit.any(axis=1)
            out[w[found]] = at[found, hit[found].argmax(axis=1)]

    every = np.arange(len(opens))
    search(every, opens // BLOCK, opens)
    live = every[out < 0]
    node, level = opens[live] // BLOCK, np.zeros(len(live), np.int64)
    climbing = np.ones(len(live), bool)
    while climbing.any():
        for k in range(len(levels) - 1):
            here = np.flatnonzero(climbing & (level == k))
            right = node[here] ^ 1
            stop = (node[here] % 2 == 0) & (levels[k][right] <= want[live[here]])
            node[here[stop]] = right[stop]
            climbing[here[stop]] = False
            node[here[~stop]] //= 2
            level[here[~stop]] += 1
        climbing &= level < len(levels) - 1
    for k in range(len(levels) - 1, 0, -1):
        here = np.flatnonzero(level == k)
        left = node[here] * 2
        node[here] = np.where(levels[k - 1][left] <= want[live[here]], left, left + 1)
        level[here] -= 1
    search(live, node, node * BLOCK - 1)
    return out


def least_in(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[start:end] for each range (not empty), by minima over powers of two."""
    out, now, width = np.empty(len(start), values.dtype), values, 1
    log = np.frexp(end - start)[1] - 1
    for k in range(int(log.max()) + 1):
        here = np.flatnonzero(log == k)
        out[here] = np.minimum(now[start[here]], now[end[here] - width])
        now = np.minimum(now[: max(0, len(now) - width)], now[width:])
        width *= 2
    return out


class Shard:
    """The trie of sorted distinct paths as parentheses, and figures of each node in preorder."""

    def __init__(self, paths: list[bytes], sizes: list[list[int]], members: np.ndarray, first: np.ndarray):
        lengths = np.array([len(p) // 16 for p in paths])
        starts = np.cumsum(lengths) - lengths
        keys = np.frombuffer(b"".join(paths), np.dtype("V16"))
        number, depth = np.repeat(np.arange(len(paths)), lengths), np.arange(len(keys)) - np.repeat(starts, lengths)
        shared = np.zeros(len(paths), np.int64)
        inside = np.flatnonzero((number > 0) & (depth < lengths[number - 1]))
        before = starts[number[inside] - 1] + depth[inside]
        pairs = keys.view(np.uint64).reshape(-1, 2)
        differs = inside[(pairs[inside] != pairs[before]).any(axis=1)]
        shared[1:] = np.minimum(lengths[1:], lengths[:-1])
        np.minimum.at(shared, number[differs], depth[differs])
        self.paths = paths
        new = np.flatnonzero(depth >= shared[number])
        self.depth = np.append(0, depth[new] + 1)
        self.bytes = np.append(0, np.array([x for s in sizes for x in s], np.int64)[new]) if len(new) else np.zeros(1, np.int64)
        n = len(self.depth)
        fresh = lengths - shared
        ends_at = np.cumsum(fresh)
        # The parentheses: the root, then of each path what it closes of the path before and what it opens.
        closing = np.append(0, lengths[:-1] - shared[1:])
        turns = np.stack((closing, fresh), axis=1).ravel()
        self.parentheses = np.concatenate(([1], np.repeat(np.tile([-1, 1], len(paths)), turns), np.full(int(lengths[-1]) + 1, -1))).astype(np.int8)
        excess = np.cumsum(self.parentheses, dtype=np.int64)
        self.open = np.flatnonzero(self.parentheses > 0)
        self.close = close_of(excess, self.open)
        self.end = np.arange(n) + (self.close - self.open + 1) // 2
        leaf = np.append((self.parentheses[:-1] > 0) & (self.parentheses[1:] < 0), False)
        rank = np.append(0, np.cumsum(leaf))
        self.leaves = rank[self.close] - rank[self.open]
        ending, smallest = np.zeros(n, np.int64), np.full(n, FAR)
        ending[ends_at], smallest[ends_at] = members, first
        self.ends_at = ends_at
        self.members = self._under(ending)
        self.first = least_in(smallest, np.arange(n), self.end)
        self.paid, self.once = self._under(self.members * self.bytes), self._under(self.bytes)
        # A node's parent is the last node before it that is a level higher.
        order = np.argsort(self.depth, kind="stable")
        place = self.depth[order] * n + order
        self.parent = np.full(n, -1)
        self.parent[1:] = place[np.searchsorted(place, (self.depth[1:] - 1) * n + np.arange(1, n)) - 1] % n
        self.children = np.bincount(self.parent[1:], minlength=n)
        self.left = np.arange(n) <= lengths[0]
        self.right = self.close > self.open[-1]

    def _under(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, which are ranges in preorder."""
        total = np.append(0, np.cumsum(values))
        return total[self.end] - total[: len(values)]

    def spine_digests(self) -> dict[int, bytes]:
        """Digests of the paths of nodes on the spines, by node."""
        out = {}
        for path, flags in ((self.paths[0], self.left), (self.paths[-1], self.right)):
            digest = hashlib.sha256()
            for node in np.flatnonzero(flags).tolist():
                if (d := int(self.depth[node])) > 0:
                    digest.update(path[16 * d - 16 : 16 * d])
                out[node] = digest.digest()[:16]
        return out


_NODES = {
    "shard": pa.int64(), "node": pa.int64(), "parent": pa.int64(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "paid": pa.int64(), "once": pa.int64(), "bytes": pa.int64(), "ends": pa.string(), "right": pa.bool_(), "digest": pa.binary(), "under_spine": pa.bool_(),
}


def _nodes(shard: int, rows: list[tuple]) -> pa.RecordBatch:
    paths, sizes, first, members, ends = zip(*rows)
    s = Shard(list(paths), list(sizes), np.array(members), np.array(first))
    n, digests = len(s.depth), s.spine_digests()
    spine = s.left | s.right
    by_node: list[str | None] = [None] * n
    for node, end in zip(s.ends_at.tolist(), ends):
        by_node[node] = end
    under = spine[s.parent] & (s.parent >= 0)
    values = [np.full(n, shard), np.arange(n), s.parent, s.depth, s.first, pa.array(s.first[s.parent], mask=s.parent < 0), s.members, s.children, s.leaves, s.paid, s.once, s.bytes, by_node, s.right, [digests.get(i) for i in range(n)], under]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(values, _NODES.values())], list(_NODES))


def _sharded(most: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "conv_id", "n", "ends"))):
                held.append(row)
                size += len(row[1]) + 1
                if size >= most:
                    yield _nodes(shard, held)
                    shard, held, size = shard + 1, [], 0
        if held:
            yield _nodes(shard, held)

    return of


def trie(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of distinct paths; see prefix_trie."""
    small_batches()
    kinds = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}
    schema = ", ".join(f"`{c}` {kinds[t]}" for c, t in _NODES.items())
    nodes = written(paths.select("path", "sizes", "conv_id", "n", "ends").repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_sharded(shard), schema), "trie")
    # A spine's node goes on in a later shard from where that shard's first path takes it up.
    spine, by_node, by_shard = nodes.where("digest IS NOT NULL"), Window.partitionBy("digest"), Window.partitionBy("shard")
    spine = spine.withColumns({"again": F.col("shard") > F.min("shard").over(by_node), "more": F.col("shard") < F.max("shard").over(by_node)})
    deeper = by_shard.orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.max(F.when(F.col("again"), F.col("depth"))).over(by_shard)
    last = F.max_by("more", F.when(F.col("right"), F.col("depth"))).over(by_shard)
    repaid = F.sum(F.when(F.col("again"), F.col("bytes"))).over(deeper)
    spine = spine.withColumns({"taken": taken, "false_leaf": last, "repaid": F.when(F.col("again"), repaid).otherwise(0)})
    spine = written(spine.withColumns({
        "n_children": F.col("n_children") - F.when(F.col("again") & (F.col("depth") < F.col("taken")), 1).otherwise(0),
        "n_leaves": F.col("n_leaves") - F.when(F.col("right") & F.col("false_leaf"), 1).otherwise(0),
        "saved_tokens": F.col("paid") - F.col("once") + F.col("repaid"),
    }), "spine")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = written(spine.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends").alias("ends"), F.min(F.struct("shard", "parent")).alias("at")), "merged")
    places = spine.select("shard", F.col("node").alias("parent"), "digest").join(merged.select("digest", F.col("conv_id").alias("parent_conv_id")), "digest").drop("digest")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")]
    inner = nodes.where("digest IS NULL").withColumn("saved_tokens", F.col("paid") - F.col("once"))
    below = inner.where("under_spine").drop("parent_conv_id").join(places, ["shard", "parent"])
    spines = merged.select("*", "at.shard", "at.parent").join(places, ["shard", "parent"], "left")
    return inner.where("NOT under_spine").select(columns).unionByName(below.select(columns)).unionByName(spines.select(columns))


def prefix_trie(conversations: DataFrame, family: int = 5, most: int = 9, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id (the parent's; the root has none), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by their number, null first, those of one number by role and then by a digest of the
    text. Null roles and texts are empty, rows without a conv_id belong to no conversation, repeated rows
    are turns of their own. A conversation that is rebuilt without turns ends at the root. saved_tokens
    sums, over a node's subtree, the members but one times the UTF-8 bytes of the last text. ends_sha256
    digests the decimal ids of the members that end at the node, in ascending order, joined by commas. Other
    columns don't matter; an empty table has no nodes. The digests of a conversation's turns (32 bytes a
    turn) are in one row; nothing else is held whole.
    """
    return trie(distinct_paths(rebuilt(own_turns(conversations), family, most)), shard)
