import random
import zlib

import numpy as np
import pytest

from hostlens.llm import langid

SYLLABLES = {"en": ["the", "and", "ing", "er"], "fr": ["éa", "que", "le", "oui"], "de": ["sch", "ich", "ung", "ä"], "es": ["ción", "lla", "os", "ñ"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80)))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    return rows


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 12):
        code = langid.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert set(np.unique(code)) <= {-1.0, 1.0} and min(gaps) >= (1 if n == 2 else code.shape[1] // 4)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(1000, None, "en", None, None), (1001, "", None, None, 0), (1002, "12 34 %% !", "fr", "x", 9), (1003, "the " * 40_000, None, "x", 1), (None, "que le oui que le", None, "x", 1), (1005, rows[0][1], None, "x", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r for r in langid.predictions(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    for r in rows:
        assert got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0)
    apart = [r for r in rows if got[r[0]].held_out]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in apart]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003].lang_pred == "en" and got[None].lang_pred == "fr" and not got[None].held_out
    assert got[1005].lang_pred == got[0].lang_pred and got[1005].score == got[0].score
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns
    sure = langid.identified(docs, langid.learn(docs)).where("guess.lang <> 'und' AND NOT guess.ambiguous")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in sure.collect()} <= set(got) - {1000, 1001, 1002}
    assert {r[0] for r in rows} <= {r.doc_id for r in kept.collect()}


def test_what_the_classifier_cannot_tell_goes(spark, monkeypatch):
    """The stage's rows are the model's: a text between two languages goes, and another model lets others go."""
    rows = corpus(200)
    between = "que le oui que le the of and that " * 3
    docs = spark.createDataFrame([*rows, (5000, between, None, "x", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.learn(docs)
    model.margin = 2.0  # nothing is sure enough
    monkeypatch.setattr(langid, "learn", lambda *_: model)
    assert langid.accepted(docs).count() == 0
    model.margin = 0.0
    assert langid.accepted(docs).count() == len(rows) + 1


def test_labels_do_not_reach_held_out_predictions(spark):
    rows = corpus(120)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    swapped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else l, "other", 0) for i, t, l, _, _ in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.predictions(spark.createDataFrame(x, schema)).collect()} for x in (rows, swapped))
    assert a == b


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predictions(docs).collect()} == {"und"}
    assert langid.predictions(docs.limit(0)).count() == 0
    assert langid.accepted(docs).count() == 1


def plain_features(text):
    """Hashed n-grams counted one at a time."""
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            h = n
            for b in text[i : i + n]:
                h = (h * 0x01000193 + fold(b)) % 2**32
            h ^= h >> 15
            h = h * 0x85EBCA6B % 2**32 >> 19
            counts[h] = counts.get(h, 0) + 1
    total = sum(counts.values())
    return {h: (c / total) ** 0.5 for h, c in counts.items()}


@pytest.mark.parametrize("stretch", [300_000, 7])
def test_features_and_decoding_against_plain_ones(monkeypatch, stretch):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    texts = [t.encode() for _, t, *_ in corpus(12)] + [b"", b"a", b"aB", "Ñandú!".encode() * 4]
    model = langid.fit([t.encode() for _, t, *_ in corpus(60, 3)], [x[2] for x in corpus(60, 3)])
    for text in texts:
        row = langid.features([text])[0]
        want = plain_features(text)
        assert set(np.flatnonzero(row)) == set(want) and all(abs(row[h] - v) < 1e-6 for h, v in want.items())
        assert (langid.unpacked([langid.packed(row)])[0] == row).all()
        margins = [sum(v * model.weights[h, k] for h, v in want.items()) + model.bias[k] for k in range(model.code.shape[1])]
        loss = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margins, word)) for word in model.code]
        share = [np.exp(min(loss) - x) for x in loss]
        best, score, near = model.predict([text])
        assert best[0] == int(np.argmin(loss)) and abs(score[0] - max(share) / sum(share)) < 1e-4
        second = sorted(share)[-2] / sum(share)
        assert near[0] == (score[0] - second < 0.1) or abs(score[0] - second - 0.1) < 1e-4


def test_more_than_256_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_ROWS", 2000)
    monkeypatch.setattr(langid, "BATCH", 1024)
    rows = []
    for k in range(300):
        word = "".join(chr(97 + (k // 17**j) % 17) for j in range(3))
        rows += [(10 * k + i, f"{word}{word} {word} " * (4 + i), f"l{k:03d}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in langid.predictions(docs).collect()}
    apart = [r for r in rows if got[r[0]].held_out]
    assert np.mean([got[i].lang_pred == x for i, _, x in apart]) > 0.9
    assert len({r.lang_pred for r in got.values()}) > 285


def test_samples_are_bounded_and_agree(spark):
    rows = [(i % 500, f"text {i}", "aa" if i % 3 else "bb") for i in range(3000)] + [(9, "again", "aa")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = ({(r.doc_id, r.lang) for r in langid.bounded(docs.repartition(n), "lang", 40).collect()} for n in (2, 5))
    assert one == two and [sum(x == k for _, x in one) for k in ("aa", "bb")] == [40, 40]
