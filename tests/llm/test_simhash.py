import random
import re

import numpy as np
import pytest
import xxhash

from hostlens.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """doc_id -> smallest doc_id reachable."""
    root = {i: i for i in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(marks)
    for i in ids:
        for j in ids:
            if i < j and bin(marks[i] ^ marks[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"W{i}é" for i in range(60)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    texts = [*base, *base[:4], None, "", " \t\n", "one", "One", "one two three", "x" * 50_000, "a b c d\x0be\x1cf"]
    for text in base[:6]:
        for _ in range(6):
            w = text.split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            texts.append("  ".join(w))
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id int").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    marks = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(marks)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(texts)
    kept = {r.doc_id for r in simhash.kept_documents(docs, simhash.FOUR_BITS).collect()}
    assert kept == set(want.values())
    assert simhash.kept_documents(docs).columns == docs.columns


def joined_components(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in edges:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("level", range(3))
def test_links_find_every_pair_at_each_level_even_when_anchors_are_split(spark, level):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 40 if level < 2 else 12, dtype=np.uint64)
    marks = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(12 if level < 2 else 4):
            x = c
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            marks.add(x)
    for i in range(200 if level < 2 else 20):
        marks.add(5 << 40 | i)
    marks = dict(enumerate(sorted(marks)))
    number = {m - (m >> 63 << 64): i for i, m in marks.items()}
    frame = spark.createDataFrame([(m,) for m in number], "node long")
    want = plain_components(marks)
    for most in (4096, 8):
        edges = simhash.links(frame, level=simhash.FOUR_BITS.levels[level], most=most).collect()
        assert all(0 < bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 4 for e in edges)
        assert joined_components(marks, [(number[e.a], number[e.b]) for e in edges]) == want
        if most == 4096 and level == 0:
            assert len(edges) < 20 * len(marks)


def comparisons(marks, level):
    homes, visits = {}, {}
    for keys, _, home in simhash.Anchors(simhash.FOUR_BITS, level).of(marks):
        for to in (homes, visits) if home else (visits,):
            for k, n in zip(*np.unique(keys, return_counts=True)):
                to[k] = to.get(k, 0) + n
    return sum(n * visits[k] for k, n in homes.items()) / len(marks) - len(level.words)  # less itself


def test_comparisons_a_fingerprint_stay_bounded():
    """As counted at small sizes and carried on in proportion, at most 40,000 up to 1e9 fingerprints."""
    rng = np.random.default_rng(2)
    marks = rng.integers(0, 2**64, (4000, 1), dtype=np.uint64)
    layout = simhash.FOUR_BITS
    assert layout.levels[0].most == 2**22
    per = [comparisons(marks[:4000], layout.levels[0]) / 4000, comparisons(marks, layout.levels[1]) / 4000]
    assert comparisons(marks[:1000], layout.levels[0]) < per[0] * 1000 * 1.5
    assert per[1] < per[0] / 100
    for n in (10**3, 10**5, 4 * 10**6, 10**7, 10**8, 10**9):
        assert per[layout.levels.index(layout.level(n))] * n < 40_000


def jaccard(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_similar_texts_are_found_by_five_words(spark):
    """Against all pairs' Jaccard similarity: recall at 0.8 and above, and hardly a link under 0.6."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    for i in range(120):
        base = [word() for _ in range(rng.randrange(150, 400))]
        copy = list(base)
        for _ in range(max(1, int(len(base) * rng.uniform(0.002, 0.08)))):
            copy[rng.randrange(len(copy))] = word()
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.kept_documents(docs).collect()}
    similar = {i: jaccard(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)}
    assert set(similar) <= kept
    high = [i + 1 not in kept for i, j in similar.items() if j >= 0.8]
    assert len(high) > 40 and np.mean(high) >= 0.95
    assert np.mean([i + 1 not in kept for i, j in similar.items() if 0.8 <= j < 0.86]) >= 0.85
    low = [i + 1 in kept for i, j in similar.items() if j < 0.6]
    assert len(low) > 10 and np.mean(low) >= 0.9


def test_texts_in_stretches(monkeypatch):
    rng = random.Random(2)
    texts = [" \n".join(rng.choices(["Ab", "c", "dé", "x" * 50], k=n)) + " " * m for n in (1, 3, 4, 5, 9, 400) for m in (0, 70)]
    whole = [simhash.fingerprint(t.encode(), w, k).tolist() for t in texts for w in (4, 5) for k in (1, 4)]
    assert [x[0] for x in whole[::4]] == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "STRETCH", 30)
    assert whole == [simhash.fingerprint(t.encode(), w, k).tolist() for t in texts for w in (4, 5) for k in (1, 4)]


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "lone text here now"), (None, None), (7, ""), (7, "")], "doc_id long, text string")
    rows = sorted(simhash.near_duplicates(docs).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in rows].count((7, 7)) == 2
    assert {(r.doc_id, r.component_id) for r in rows} == {(7, 7), (None, 7), (None, None)}
