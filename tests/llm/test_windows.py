import hashlib
import random
import re

import numpy as np
import pytest

from hostlens.llm import windows

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(rows, length=20):
    """Per row: words, removed words, digest; a window repeats if an equal one has a smaller (doc_id, start)."""
    first = {}
    words = [WORDS.findall((t or "").encode()) for _, t in rows]
    key = lambda i: -(2**63) if i is None else i
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - length + 1):
            x = tuple(w[s : s + length])
            first[x] = min(first.get(x, (key(i), s)), (key(i), s))
    out = []
    for (i, _), w in zip(rows, words):
        hit = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (key(i), s):
                hit[s : s + length] = [True] * length
        out.append((i, len(w), sum(hit), hashlib.sha256(b" ".join(x for x, h in zip(w, hit) if not h)).hexdigest()))
    return sorted(out, key=repr)


def sample(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice(["a", "b", "ünd", "the", "of", "c" * rng.randrange(1, 9)]) + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\x0c\r"]) for _ in range(n))
    passages = [prose(rng.randrange(15, 60)) for _ in range(5)]
    texts = [prose(rng.randrange(0, 150)) for _ in range(30)]
    texts += [prose(12) + rng.choice(passages) + prose(25) for _ in range(40)]
    texts += [" ".join("xyz") * 3, "a " * 400, "a b " * 90, "ab " * 19, "ab " * 20, None, "", " \n", texts[0] * 2, *texts[2:6], *[texts[31]] * 9]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[32]), (None, prose(30)), (7, texts[33]), (14, None), rows[40], rows[40]]


@pytest.mark.parametrize("seed", range(3))
def test_equals_every_window_counted(spark, seed):
    rows = sample(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = windows.without_repeats(docs, flush=300, bucket=900)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == plain(rows)
    for row in got.collect():
        spans = [(s["start"], s["end"]) for s in row["spans"]]
        assert row["n_removed"] == sum(b - a for a, b in spans)
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:])), "intervals are maximal"


def test_other_lengths_and_one_bucket(spark):
    rows = sample(9)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, mark int")
    got = windows.without_repeats(docs, length=3).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, 3)


def test_empty_table_and_text_ids(spark):
    assert windows.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="integer"):
        windows.without_repeats(spark.createDataFrame([], "doc_id string, text string"))


def test_very_long_texts_go_in_stretches(spark, monkeypatch):
    rng = random.Random(3)
    passage = " ".join(rng.choice("abcdefghij") * 3 for _ in range(60))
    filler = lambda n: " ".join(f"w{rng.random()}" for _ in range(n))
    long = " ".join(filler(9000) + " " + passage for _ in range(9))
    rows = [(1, long), (2, filler(5) + " " + passage), (3, "y" * 1_500_000), (4, "z" * 1_200_000 + " " + passage)]
    got = windows.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == plain(rows)


def test_a_frequent_window_is_a_row_of_a_flush(spark):
    """One document of which half of all rows are copies: what is dealt out is one document's windows a flush."""
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, text if i % 2 else f"{text} {i}") for i in range(2000)], "doc_id long, text string").coalesce(1)
    keyed = windows._keyed(docs).select("id", "mark", "bytes")
    sent = keyed.mapInArrow(windows._send(20, 4, 1 << 20), windows._SCHEMA).toPandas()
    counted = sent[sent.bucket < 4]
    assert sum(map(len, counted["hashes"])) // 8 == 181 + 1000
    assert windows.without_repeats(docs).where("n_removed = 0").count() == 1


def test_hashes_tell_windows_apart():
    data = np.frombuffer(b"a b c d a b c a b d", np.uint8)
    words, counts = windows.word_hashes(data, np.array([0, 7, len(data)]))
    assert counts.tolist() == [4, 6]
    h, g = windows.window_hashes(words, 2)
    text = bytes(data).split()
    for x in (h, g):
        for i in range(9):
            for j in range(9):
                assert (x[i] == x[j]) == (text[i : i + 2] == text[j : j + 2])
