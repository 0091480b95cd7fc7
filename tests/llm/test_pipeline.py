import random
import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from hostlens.llm import mixing  # noqa: E402


def prose(rng, n):
    return " ".join("".join(rng.choices(["the", "an", "er", "ing", "ou", "st", "wh", "le", "mo", "ka"], k=rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    path = tmp_path_factory.mktemp("sf")
    texts = {i: prose(rng, rng.randrange(30, 90)) for i in range(60)}
    passage, items = prose(rng, 80), [prose(rng, 30) for _ in range(5)]
    copies, near, shared, leaks, junk = [], [], [], [], []
    for i in range(4):
        texts[100 + i] = texts[i]
        copies.append(100 + i)
    long = prose(rng, 400)
    texts[70] = long
    for i in range(3):
        texts[110 + i] = long + " " + "k" * (i + 1)
        near.append(110 + i)
    for i in range(3):
        texts[120 + i] = f"{prose(rng, 20)} {passage} {prose(rng, 20)}"
        shared.append(120 + i)
    for i in range(5):
        texts[130 + i] = f"{prose(rng, 10)} {items[i]} {prose(rng, 10)}"
        leaks.append(130 + i)
    for i, t in enumerate(["", None, "12 34 !!", " \n"]):
        texts[140 + i] = t
        junk.append(140 + i)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {"dir": str(path), "texts": texts, "passage": passage, "copies": copies, "near": near, "shared": shared, "leaks": leaks, "junk": junk}


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables['dir']}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables["dir"])
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append({r.doc_id: r for r in docs.collect()})
    one, two, three, four = seen
    texts = tables["texts"]
    assert set(texts) - set(one) == set(tables["junk"])
    assert set(one) - set(two) == {*tables["copies"], *tables["near"]}
    assert set(three) == set(two)
    for i in tables["shared"]:
        kept = three[i].text
        assert len(kept) < 320 and tables["passage"][20:60] not in kept and three[i].n_chars == len(kept)
        assert texts[i].startswith(kept[:40]) and texts[i].endswith(kept[-40:])
    assert all(three[i].text == texts[i] for i in three if i not in tables["shared"])
    assert set(three) - set(four) == set(tables["leaks"])
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = np.zeros(3)
    for r in four.values():
        sizes[int(r.source[1])] += words(r.text)
    want = mixing.targets(sizes, np.array([3.0, 1.0, 2.0]))
    got = np.zeros(3)
    last = corpus_pipeline.run(spark, tables["dir"]).collect()
    for r in last:
        got[int(r.source[1])] += words(r.text)
        assert r.doc_id in four
    assert np.abs(got - want).max() <= 1


def test_repeated_rows_and_null_ids_keep_one_document(spark):
    rng = random.Random(12)
    texts = [prose(rng, 120) for _ in range(5)]
    rows = [(1, texts[0], "en"), (1, texts[0], "en"), (None, texts[1], "en"), (None, texts[1], "en"), (None, texts[1], "de"), (None, texts[2], "en"), (3, texts[2], "en"), (4, texts[3], "en"), (4, texts[3], None), (5, texts[4], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    two = corpus_pipeline.near_dedup(spark, docs, "")
    assert two.columns == docs.columns
    assert sorted((r.doc_id or 0, texts.index(r.text)) for r in two.collect()) == [(0, 1), (1, 0), (3, 2), (4, 3), (5, 4)]
    three = corpus_pipeline.drop_repeats(spark, two, "").collect()
    assert sorted((r.doc_id or 0, texts.index(r.text)) for r in three) == [(0, 1), (1, 0), (3, 2), (4, 3), (5, 4)]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mix"]
