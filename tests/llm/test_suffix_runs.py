import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hostlens.llm import suffix_runs


def plain(texts, length=200):
    """Per text: removed runs, by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        hit = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(int), [0]))))
        out.append((len(r), int(hit.sum()), len(edge) // 2, hashlib.sha256(bytes(b for b, h in zip(r, hit) if not h)).hexdigest()))
    return out


def sample(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    line = prose(25)
    texts = [prose(rng.randrange(1, 300)) for _ in range(25)]
    texts += [prose(30) + p + prose(40) for p in passages for _ in range(6)]
    texts += [prose(20) + line[:150] + prose(20) for _ in range(12)] + [prose(9) + line + prose(9) for _ in range(5)]
    near = prose(150)
    for _ in range(8):
        i = rng.randrange(len(near))
        texts.append(near[:i] + "X" + near[i + 1 :])
    texts += texts[:3] + [None, "", "a" * 5000, "a" * 199, "b" * 200, "b" * 200, "ab" * 150, texts[5] * 2]
    return texts


def test_run_index_matches_plain_matching_statistics():
    rng = np.random.default_rng(1)
    for data in (rng.integers(97, 99, 300), np.tile(rng.integers(97, 123, 40), 6), np.full(50, 97), np.array([97])):
        data = data.astype(np.uint8)
        index = suffix_runs.RunIndex(data)
        text = data.tobytes()
        want = [max([0, *(next((k for k in range(len(text)) if i + k >= len(text) or j + k >= len(text) or text[i + k] != text[j + k]), 0) for j in range(len(text)) if j != i)]) for i in range(len(text))]
        assert index.matching_statistics().tolist() == want
        assert index.run_lengths.sum() == len(data)


@pytest.mark.parametrize("most", [1000, 3, 0])
def test_documents_against_brute_force(spark, most):
    texts = sample(most)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    keyed = suffix_runs._keyed(docs)
    spans = {}
    for r in suffix_runs.repeats(keyed, most=most).collect():
        spans.setdefault(r.id, []).append((r.start, r.end))
    want = plain(texts)
    for i, (n, removed, runs, _) in enumerate(want):
        got = suffix_runs.merged(spans.get(i, []))
        assert (sum(e - s for s, e in got), len(got)) == (removed, runs), i
    if most == 1000:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_runs.removed_bytes(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_long_texts_cut_in_stretches(monkeypatch):
    monkeypatch.setattr(suffix_runs, "POSITION_BITS", 11)
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([data.tobytes()], pa.binary())], ["id", "mark", "bytes"])
    rows = pa.Table.from_batches(list(suffix_runs._cut_batch(batch, 200))).to_pydict()
    got = sorted(p for a, b in zip(rows["lo"], rows["hi"]) for p in range(a, b + 1))
    assert got == list(range(9000 - 199))


def test_text_left_over(spark):
    p = "".join(random.Random(3).choices("qwertyüio ", k=260))
    docs = spark.createDataFrame([(1, f"left {p} end", 9, "a"), (2, f"other {p} tail", 9, "b"), (3, "alone", 5, None), (4, None, None, "c"), (None, p, 1, "d")], "doc_id long, text string, n_chars long, mark string")
    got = {r.doc_id: r for r in suffix_runs.without_repeats(docs).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].text.startswith("left") and got[1].text.endswith("end") and got[1].n_chars == len(got[1].text) < 20
    assert got[3].text == "alone" and got[4].text is None and got[3].n_chars == 5
    assert suffix_runs.without_repeats(docs).columns == docs.columns
    assert suffix_runs.removed_bytes(docs.limit(0)).count() == 0
