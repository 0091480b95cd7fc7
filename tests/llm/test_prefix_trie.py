import hashlib
import random
import zlib

import numpy as np
import pytest

from hostlens.llm import prefix_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Every node by a dictionary of prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    members = {}
    paths = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(paths[c]) + 1):
            members.setdefault(paths[c][:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in m if paths[c] == p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(q not in kids for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def sample(seed, n=90):
    rng = random.Random(seed)
    texts = ["", None, "ä", "hello", "ok", "a longer turn of words"]
    rows = []
    for c in rng.sample(range(-20, 400), n):
        if rng.random() < 0.3:
            said = [("user", "hot"), ("assistant", "same")] * rng.randrange(1, 6)
        else:
            said = [(rng.choice(["user", "assistant", None]), rng.choice(texts)) for _ in range(rng.randrange(1, 14))]
        rows += [(c, None if k == 0 and rng.random() < 0.2 else k, *x) for k, x in enumerate(said)]
    return rows + [rows[3], rows[3], (None, 1, "user", "x")]


@pytest.mark.parametrize("shard", [1, 7, 60, 1 << 19])
@pytest.mark.parametrize("seed", range(2))
def test_equals_a_dictionary_of_prefixes(spark, seed, shard):
    rows = sample(seed)
    random.Random(seed).shuffle(rows)
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")
    got = trie.prefix_trie(table, shard=shard).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_conversations_without_turns_end_at_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(40)]
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), shard=1)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=repr) == plain(rows)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_very_long_conversation(spark):
    rows = [(5, k, "user", f"t{k}") for k in range(3000)] + [(6, k, "user", f"t{k}" if k < 1500 else f"u{k}") for k in range(3000)]
    got = {r["depth"]: r for r in trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), shard=100).where("conv_id = 5").collect()}
    assert len(got) == 3001 and got[0]["n_leaves"] == 2 and got[1500]["n_children"] == 2 and got[1501]["n_convs"] == 1
    assert got[0]["saved_tokens"] == sum(len(f"t{k}") for k in range(1500))


def test_ids_of_a_path_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 60)
    ids = random.Random(1).sample(range(-500, 10**6), 200)
    convs = spark.createDataFrame([(c, [("k" * 32, 3)]) for c in ids], "conv_id long, turns array<struct<key:string,bytes:int>>").withColumn("turns", trie.F.expr("transform(turns, t -> struct(repeat('ab', 16) AS key, t.bytes AS bytes))"))
    [row] = trie.distinct_paths(convs).collect()
    assert (row["n"], row["conv_id"]) == (200, min(ids))
    assert row["ends"] == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def test_close_of_matches_a_stack():
    rng = random.Random(4)
    for n in (1, 2, 40, 500, 9000):
        bits, depth, left = [1], 1, n - 1
        while left or depth > 1:
            if left and (depth == 1 or rng.random() < 0.6):
                bits.append(1)
                depth, left = depth + 1, left - 1
            else:
                bits.append(-1)
                depth -= 1
        bits.append(-1)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b > 0:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.array(sorted(want))
        assert trie.close_of(np.cumsum(bits), opens).tolist() == [want[i] for i in opens.tolist()]


def test_a_shard_reads_its_tree():
    key = lambda x: bytes([x]) * 16
    s = trie.Shard([key(1), key(1) + key(2), key(1) + key(3) + key(4), key(5)], [[3], [3, 4], [3, 5, 6], [7]], np.array([2, 1, 4, 1]), np.array([9, 3, 2, 8]))
    assert "".join("()"[int(b < 0)] for b in s.parentheses) == "((()(()))())"
    assert s.depth.tolist() == [0, 1, 2, 2, 3, 1] and s.parent.tolist() == [-1, 0, 1, 1, 3, 0]
    assert s.members.tolist() == [8, 7, 1, 4, 4, 1] and s.leaves.tolist() == [3, 2, 1, 1, 1, 1]
    assert s.first.tolist() == [2, 2, 3, 2, 2, 8] and s.children.tolist() == [2, 2, 0, 1, 0, 0]
