import random
import re

import numpy as np

from hostlens.llm import mixing


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", "Z", "é", None, "tiny"] if i > 3 else ["tiny"])
        if source == "tiny" and rng.random() < 0.8:
            source = "a"
        rows.append((i, " ".join(rng.choices(["x", "yé", "zz\tq", "w\nv"], k=rng.randrange(0, 60))), source, 7))
    return rows + [(5000, None, "a", 1), (5001, "w " * 20_000, "b", 1), (None, "one two", "b", 1), (7, rows[7][1], rows[7][2], 7), (6000, None, "void", 1)]


def check(rows, got):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = mixing.targets(np.array([sizes[s] for s in order], float), np.resize([3.0, 1.0, 2.0], len(order)))
    assert abs(want.sum() - 1.5 * sum(sizes.values())) < 1e-6
    assert all(w <= 2 * sizes[s] for s, w in zip(order, want))
    taken = {}
    for r in got:
        s = r.doc.source
        assert r["size"] == words(r.doc.text) and 0 <= r.taken <= 2 * r["size"]
        assert r.source_size == sizes[s] and abs(r.target - want[order.index(s)]) < 1e-6
        assert r.taken == sum(d.words for d in r.draws)
        taken[s] = taken.get(s, 0) + r.taken
    for s, w in zip(order, want):
        assert abs(taken[s] - w) <= 1, s


def test_plan_and_mix(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(4)
    got = mixing.planned(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)
    again = mixing.planned(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc.doc_id), r.taken, sorted((d.shard, d.epoch, d.words) for d in r.draws))
    assert sorted(map(key, got)) == sorted(map(key, again))
    mix = mixing.mixed(docs, shards=4).collect()
    assert sum(r.mix_words for r in mix) == sum(r.taken for r in got)
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.mix_words for r in mix)
    assert {r.mix_shard for r in mix} == {0, 1, 2, 3}
    assert mixing.planned(docs.limit(0)).count() == 0


def test_targets_share_the_excess():
    got = mixing.targets(np.array([10.0, 1000.0, 1000.0, 0.0]), np.array([3.0, 1.0, 2.0, 3.0]))
    assert got[0] == 20 and got[3] == 0 and abs(got.sum() - 1.5 * 2010) < 1e-9 and (got <= np.array([20, 2000, 2000, 0])).all()


def test_splitting_tree_adds_up():
    counts = np.array([100, 7, 0, 333])
    got = mixing.split(counts, 7, np.random.default_rng(2))
    assert (got.sum(1) == counts).all() and (got >= 0).all() and np.ptp(got.sum(0)) <= 3


def test_splits_are_hypergeometric_at_any_size():
    """Means and variances of the draws against their formulas, and counts at the largest that sources may have together."""
    counts, shards, n = np.array([40, 25, 5]), 4, 4000
    rng = np.random.default_rng(3)
    draws = np.stack([mixing.split(counts, shards, rng) for _ in range(n)])
    total = counts.sum()
    size = draws[0].sum(0)
    for s in range(shards):
        mean = counts * size[s] / total
        spread = size[s] * counts / total * (1 - counts / total) * (total - size[s]) / (total - 1)
        assert np.abs(draws[:, :, s].mean(0) - mean).max() < 0.2
        assert np.abs(draws[:, :, s].var(0) / spread - 1).max() < 0.15
    large = np.full(4578, 3 * (mixing.ALL_BLOCKS // 4578))
    got = mixing.split(large, 16, rng)
    assert (got.sum(1) == large).all() and np.ptp(got.sum(0)) <= 4
    assert got.std() > 0.5 * np.sqrt(large[0] / 16)


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b {i}", f"s{i % 2}") for i in range(60)], "doc_id long, text string, source string")
    mixing.write_shards(mixing.mixed(docs, shards=2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).agg({"mix_words": "sum"}).first()[0] == 270
