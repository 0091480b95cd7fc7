import random
import re

from hostlens.llm import licenses


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_base(text):
    w = plain_words(text)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split(" ")
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_matching_statistics_against_brute_force():
    rng = random.Random(2)
    sequences = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 14))] for _ in range(6)]
    a = licenses.Automaton()
    for i, s in enumerate(sequences):
        a.add(i, s)
    a.close()
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(40):
        text = [rng.randrange(1, 5) for _ in range(30)]
        for i, (state, length) in enumerate(a.stream(text)):
            want = max([0, *(n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs)])
            assert length == want
            if length:
                ends = {(k, e) for k, s in enumerate(sequences) for e in range(length, len(s) + 1) if s[e - length : e] == text[i + 1 - length : i + 1]}
                assert set(a.ends[state]) == ends


def test_documents(spark):
    rng = random.Random(3)
    bits = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "MIT", "CC-BY", "ümlaut", "the", "of", "x9", "Apache\x00License", "–", "gnu general public license", "٣"]
    texts = [" ".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(80)]
    mit = licenses.TEMPLATES[0][1]
    texts += [None, "", "!!", "cc by", "a " * 30_000 + "mit license", mit, "so " + mit[: len(mit) * 3 // 4] + " end", mit[:60], mit.replace(" copy,", " copy and even"), "Licensed under the Apache License, Version 2.0.", "All rights reserved. All RIGHTS reserved"]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, "MIT License", 1.0)], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t), i
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)
    n = 80
    assert got[n + 5].labels == "mit" and got[n + 5].score == 1 and got[n + 5].spans[0].end == got[n + 5].n_words
    assert got[n + 6].labels == "mit" and 0.6 < got[n + 6].score < 1 and got[n + 6].spans[0].start == 1
    assert got[n + 7].labels == "" and got[n + 8].labels == "mit"
    assert got[n + 9].labels == "apache,apache-2.0"
    assert got[n + 10].labels == "all-rights-reserved" and len(got[n + 10].spans) == 2
    assert got[None].base_labels == "mit"
    assert licenses.scanned(docs.limit(0)).count() == 0


def test_whole_licenses():
    whole = licenses.whole_texts()
    found = licenses.scanner(whole)
    rng = random.Random(4)
    texts = [text for _, text in whole]
    worn = []
    for text in texts:
        kept = [w for w in re.split(r"\s+", text) if rng.random() > 0.02]
        worn.append("intro words " + " ".join("zzz" if rng.random() < 0.01 else w for w in kept))
    rows = found.scan([x.encode() for x in [*texts, *worn, texts[0] + " and then " + texts[-1]]])
    names = [label for label, _ in whole]
    for label, row in zip(names * 2, rows):
        assert {s["label"] for s in row[7]} & set(names) >= {label}, label
        versions = {n for n in names if n.rsplit("-", 1)[0] == label.rsplit("-", 1)[0]}
        assert {s["label"] for s in row[7]} & versions == {label}, (label, row[5])
    assert all(r[6] == 1 for r in rows[: len(names)]) and {names[0], names[-1]} <= set(rows[-1][5].split(","))


def test_pairs_cut_no_match():
    rng = random.Random(8)
    known = [w.decode() for w in licenses.words(licenses.TEMPLATES[0][1])]
    texts = [" ".join(rng.choice([" ".join(known[i : i + rng.randrange(1, 30)]), rng.choice(known), "gnu general public license", "cc by", "qqq"]) for i in rng.choices(range(60), k=12)) for _ in range(60)]
    found = licenses.Scanner()
    for text, row in zip(texts, found.scan([t.encode() for t in texts])):
        assert (row[0], row[1], row[2], row[3], row[4]) == plain_base(text)


def test_hostile_texts_end_soon():
    import time

    found = licenses.scanner(licenses.whole_texts())
    start = time.time()
    found.scan([("under the terms of the gnu general public license as published by the free software foundation " * 10_000).encode(), ("all rights reserved " * 50_000).encode()])
    assert time.time() - start < 30


def test_many_licences_in_one_text():
    """A licence over and over: twice the text takes about twice the time, and each place is found."""
    import time

    found = licenses.Scanner([*licenses.TEMPLATES, *licenses.whole_texts()], n_short=len(licenses.TEMPLATES))
    mit = dict(licenses.whole_texts())["mit"]
    took = []
    for copies in (500, 4000):
        start = time.time()
        row = found.scan([((mit + " zz ") * copies).encode()])[0]
        took.append(time.time() - start)
        assert sum(s["label"] == "mit" for s in row[7]) == copies
    assert took[1] < 24 * took[0] + 1


def test_of_versions_the_middle_decides():
    rng = random.Random(5)
    found = licenses.Scanner([*licenses.TEMPLATES, *licenses.whole_texts()], n_short=len(licenses.TEMPLATES))
    whole = dict(enumerate([len(s) for s in found.sequences[: found.n_templates]]))
    for _ in range(300):
        spans = {}
        for t in rng.sample(range(found.n_short, found.n_templates), 4):
            at, mine = rng.randrange(40), []
            for _ in range(rng.randrange(1, 5)):
                size = rng.randrange(1, 60)
                mine.append((at, at + size, rng.random()))
                at += size + rng.randrange(30)
            spans[t] = mine
        flat = [(t, *s) for t, mine in spans.items() for s in mine]
        for t, a, b, c in flat:
            want = any(2 * (min(b, y) - max(a, x)) > b - a and z * whole[u] > c * whole[t] for u, x, y, z in flat)
            assert found._beaten(t, a, b, c, spans) == want
