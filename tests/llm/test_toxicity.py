import random
import re
import zlib

import numpy as np
import pytest

from hostlens.llm import toxicity

BAD = ["vileword", "grobian", "méchant"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(["the", "an", "er", "ing", "ou", "st"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(10, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words).capitalize() + ".", "en"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_tokens_are_whole_words():
    texts = [b"Abc de\xc3\xa9, abc", b"", b"abc", b"x" * 50, b"abcdef abcdez"]
    word, prefix, first = toxicity.tokens(texts)
    assert first.tolist() == [0, 5, 7, 10, 13, 17]
    assert word[0] == word[2] == word[7] and word[0] != word[1]
    assert prefix[13] == prefix[14] and word[13] != word[14]
    assert (word[[3, 4, 5, 6]] == 1 << toxicity.TABLE_BITS).all()
    alone = toxicity.tokens([texts[4]])
    assert alone[0].tolist() == word[13:17].tolist()


def test_held_out_scores(spark):
    rows, labels = corpus()
    odd = [(9000, None, None), (9001, "", "en"), (9002, "VILEWORD " + "the er " * 30_000, "en"), (None, "grobian the an", "de")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    marks = spark.createDataFrame([*labels, (5, 0, None), (None, 0, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, marks).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    apart = [(got[i].score, t) for i, _, t in labels if got[i].held_out]
    bad, good = ([s for s, t in apart if t == k] for k in (1, 0))
    assert np.mean([a > b for a in bad for b in good]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert got[9000].predicted == got[9001].predicted == 0
    assert got[9000].score == got[9001].score
    assert got[9002].predicted == 1


def test_a_very_long_text_teaches_with_parts(spark):
    """The first in the order of the hash is longer than all that may teach; the others teach all the same."""
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bad = [i for i, _, t in labels if t and zlib.crc32(str(i).encode()) % 4 != 2]
    first = docs.where(toxicity.F.col("doc_id").isin(bad)).orderBy(toxicity.F.xxhash64("doc_id", toxicity.F.lit(11))).first().doc_id
    longer = docs.withColumn("text", toxicity.F.when(toxicity.F.col("doc_id") == first, toxicity.F.expr("repeat(text || ' ', cast(17e6 / length(text) as int))")).otherwise(toxicity.F.col("text")))
    scores = [r.score for r in toxicity.scored(longer, marks).collect()]
    assert max(scores) > 0.3 > min(scores)
    part = docs.limit(1).select(toxicity.teaching_part(toxicity.F.expr("repeat('é', 1000000)")).alias("t")).first().t
    assert len(part) == 8 * (toxicity.TEACHES // 8) + 7


def test_one_label_only_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (3, "b", "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.scored(docs, marks).collect()] == [0.0, 0.0]
    assert toxicity.scored(docs.limit(0), marks.limit(0)).count() == 0


def plain_logit(model, text):
    """Words by a loop, each filter at each word by a dot product, the strongest of each."""
    words = [w for w in re.split(rb"[^a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text)) if w]

    def slot(data, add):
        h = sum(b * toxicity._BASE**i for i, b in enumerate(data)) % 2**64
        h = (h + add) % 2**64
        return (h ^ h >> 32) * int(toxicity._MIX) % 2**64 >> 64 - toxicity.TABLE_BITS

    rows = [model.table[slot(w, 0)] + model.table[slot(w[: toxicity.PREFIX], 1)] for w in words] + [np.zeros(toxicity.SIZE)] * 2
    pooled = []
    for n in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = max([0.0, *(sum(float(rows[i + j] @ model.filters[n][j][:, f]) for j in range(n)) for i in range(len(words)))])
            pooled.append(max(0.0, best + float(model.bias[n][f])))
    return float(np.array(pooled) @ model.weights + model.constant)


@pytest.mark.parametrize("stretch,words", [(300_000, 50_000), (64, 50_000), (64, 5)])
def test_pooling_against_a_plain_one(monkeypatch, stretch, words):
    """The same alone, with others, and in stretches."""
    rows, labels = corpus(150)
    model = toxicity.fit([t.encode() for _, t, _ in rows], np.array([t for _, _, t in labels], np.float32), epochs=2)
    lookup = model.lookup()
    texts = [t.encode() for _, t, _ in rows[:15]] + [b"", b"...", b"VileWord", "Méchant, grobian!".encode(), b"a b", b"the an " * 60]
    want = [plain_logit(model, t) for t in texts]
    assert np.allclose(model.logits(texts, lookup), want, atol=1e-4)
    assert np.allclose(model.logits(texts[::-1], lookup), want[::-1], atol=1e-4)
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    monkeypatch.setattr(toxicity, "STRETCH_WORDS", words)
    assert np.allclose([model.logits([t], lookup)[0] for t in texts], want, atol=1e-4)


def test_training_beats_its_start():
    """Two words that are bad together only: no word's log-odds tells these, the filters of two words do."""
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(1200):
        words = ["".join(rng.choices(["the", "an", "er", "ing", "ou", "st"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(10, 40))]
        label = i % 2
        at = rng.randrange(len(words) - 3)
        if label:
            words[at : at + 2] = ["rotten", "rascal"]
        else:
            words[at], words[-1] = "rotten", "rascal"
        texts.append(" ".join(words).encode())
        labels.append(label)
    labels = np.array(labels, np.float32)
    rows = toxicity.packed(texts)

    def auc(model):
        logits = model.logits(texts[900:], model.lookup())
        bad, good = logits[labels[900:] == 1], logits[labels[900:] == 0]
        return np.mean((bad[:, None] > good) + 0.5 * (bad[:, None] == good))

    start, trained, random_start = (auc(toxicity.train(rows[:900], labels[:900], epochs=e, informed=i)) for e, i in ((0, True), (12, True), (12, False)))
    print(start, trained, random_start)
    assert trained > start + 0.1 and trained > 0.9 and random_start > 0.9


def test_bytes_that_teach_are_bounded(spark, monkeypatch):
    rows, labels = corpus(200)
    docs = spark.createDataFrame([*rows, *[(7, rows[7][1], "en")] * 50], "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    made = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, labels, **k: seen.append(rows) or made(rows, labels, epochs=1))
    monkeypatch.setattr(toxicity, "MOST_BYTES", 3000)
    toxicity.learn(docs, marks)
    assert 4 < len(seen[0]) < 40


def test_thresholds_come_from_all_that_is_not_trained_on(spark, monkeypatch):
    """Of 400 documents 8 of each label may train; every other labelled one counts once, whole, whatever the bounds."""
    rows, labels = corpus(400)
    docs = spark.createDataFrame([*rows, *[rows[7]] * 5], "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen, trained = [], []
    calibrate, train = toxicity.calibrate, toxicity.train
    monkeypatch.setattr(toxicity, "calibrate", lambda model, counts: seen.append(counts) or calibrate(model, counts))
    monkeypatch.setattr(toxicity, "train", lambda rows, labels, **k: trained.append(labels) or train(rows, labels, epochs=1))
    model = toxicity.learn(docs, marks, most=8)
    known = [t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sum(r.n for r in seen[0]) == len(known) - len(trained[0]) and len(trained[0]) <= 16
    assert sum(r.hits for r in seen[0]) == sum(known) - int(trained[0].sum())
    assert all(r.low <= r.high and r.bin <= r.low * toxicity.BINS <= r.bin + 1 for r in seen[0])
    assert "" in model.shift


def test_best_threshold_against_every_cut():
    rng = random.Random(8)
    for _ in range(20):
        logits = [rng.gauss(0, 3) for _ in range(60)]
        labels = [int(x + rng.gauss(0, 2) > 1) for x in logits]
        counts = [toxicity.Row(bin=i, n=1, hits=t, low=x, high=x) for i, (x, t) in enumerate(sorted(zip(logits, labels)))]
        f1 = lambda cut: 2 * sum(t for x, t in zip(logits, labels) if x >= cut) / (sum(x >= cut for x in logits) + sum(labels))
        assert f1(toxicity._best_threshold(counts)) == max(map(f1, logits))


def test_texts_of_thresholds_are_not_shuffled(spark):
    """Where labels are too many to broadcast, ids and logits are joined to them, not texts; scores are those of the model that is learnt alone."""
    rng = random.Random(5)
    rows, labels = corpus(300)
    rows = [(i, t + " " + " ".join(f"{rng.getrandbits(64):x}" for _ in range(1000))) for i, t, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.count()
    shuffled = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before, threshold = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.score for r in toxicity.scored(docs, marks, most=8).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert shuffled() - before < 0.2 * sum(len(t) for _, t in rows)
    model = toxicity.learn(docs, marks, most=8)
    want = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(toxicity.F.col("text"), model).alias("s")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
