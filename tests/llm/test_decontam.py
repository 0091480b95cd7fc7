import random
import re

import numpy as np
import pytest

from hostlens.llm import decontam


def prose(rng, n):
    return " ".join("".join(rng.choices(["the", "an", "er", "ing", "ou", "st", "é", "wh", "le"], k=rng.randrange(1, 5))) for _ in range(n))


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[i] = "x"
        elif kind == 1:
            chars.insert(i, "q")
        else:
            del chars[i]
    return "".join(chars)


def plain_normalised(text):
    """Spelt out with regular expressions, apart from the module's."""
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
    return re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", low)


def plain_windows(item):
    """(window, edit budget) as the docstring has them."""
    data = plain_normalised(item).strip()
    if len(data) < 64:
        starts, size = [0], len(data)
    else:
        starts, size = sorted({*range(0, len(data) - 64, 16), len(data) - 64}), 64
    return [(data[i : i + size], min(size * 8 // 100, (size - 10) // 10)) for i in starts]


def least_edits(window, data):
    """Least edits of the window against any stretch of data, by full dynamic programming."""
    data = np.frombuffer(data, np.uint8)
    row = np.zeros(len(data) + 1, int)
    for i, c in enumerate(window):
        new = np.empty_like(row)
        new[0] = i + 1
        step = np.minimum(row[1:] + 1, row[:-1] + (data != c))
        down = np.arange(1, len(data) + 1)
        new[1:] = np.minimum(np.minimum.accumulate(step - down), new[0]) + down
        row = new
    return row.min()


def plain(text, item):
    data = plain_normalised(item).strip()
    mine = plain_normalised(text or "")
    if not data:
        return False
    if len(data) < 24:
        return b" " + data + b" " in b" " + mine + b" "
    return any(least_edits(w, mine) <= k for w, k in plain_windows(item))


def test_against_plain_alignment(spark):
    rng = random.Random(4)
    items = [prose(rng, rng.randrange(12, 40)) for _ in range(8)] + ["too Short", None, "ab " * 60, "é", "!!", "a b, c", "thean ering oust whle stan"]
    items.append(items[0])
    docs = []
    for i in range(110):
        text = prose(rng, rng.randrange(5, 60))
        kind = i % 7
        if kind < 6:
            item = items[rng.randrange(8)]
            at = rng.randrange(len(item))
            part = (item, item, item[: rng.randrange(40, len(item))], item, item[at : at + rng.randrange(50, 130)], items[14])[kind]
            text += " " + edited(rng, part, (0, 6, 3, 14, 2, 2)[kind]).upper() + "!! " + prose(rng, 9)
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, "x"), (503, "ab " * 500), (None, "Say: " + items[1]), (505, prose(rng, 9) * 200 + items[2]), (506, "It is TOO-short, é"), (507, "tootoo short. a\tb c d"), (508, "éé too shorts")]
    frame = spark.createDataFrame([(*d, "e", 1) for d in docs], "doc_id long, text string, end string, item int").repartition(4)
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    rows = decontam.matches(frame, bench).collect()
    got = {(r.doc_id, int(r.item_id[1:])) for r in rows}
    want = {(d, i) for d, t in docs for i, item in enumerate(items) if item and t and plain(t, item)}
    assert got == want and len(want) > 40 and len(got) == len(rows)
    assert {i for _, i in want} >= {8, 10, 11, 13, 14, 15} and 12 not in {i for _, i in want}
    kept = decontam.clean(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    where = {(r.doc_id, r.item_id): r for r in rows}
    hit = where[None, "i1"]
    assert hit.start <= 5 and hit.end >= len(docs[-5][1].encode()) - 1 and hit.edits == 0


def test_quotes_of_79_bytes_are_found_at_every_offset():
    rng = random.Random(9)
    item = prose(rng, 60)
    data = plain_normalised(item)
    finder = decontam.Finder(decontam.build([item.encode()]))
    other = prose(random.Random(10), 30).encode()
    texts = [b"%s %s %s" % (other, data[i : i + 79], other) for i in range(0, len(data) - 79)]
    assert all(finder.found([t])[0] for t in texts)
    assert finder.found([other])[0] == []


@pytest.mark.parametrize("most", [decontam.MOST_HITS, 500])
def test_long_and_repetitive_texts(monkeypatch, most):
    """The same in stretches and small blocks; memory is bounded though items and text share most q-grams."""
    rng = random.Random(11)
    common = prose(rng, 20)
    items = [f"{common} {prose(rng, 14)}" for _ in range(30)]
    finder = decontam.Finder(decontam.build([x.encode() for x in items] + [b"tiny one"]))
    monkeypatch.setattr(decontam, "MOST_HITS", most)
    text = (common + " zz ") * 40 + prose(rng, 300) + " " + items[7] + " tiny, one " + " " * 3000 + prose(rng, 40) + items[3][:90]
    whole = finder.found([text.encode()])[0]
    assert {r["item"] for r in whole} >= {7, 30} and len(whole) == 31
    monkeypatch.setattr(decontam, "STRETCH", 700)
    parts = finder.found([text.encode()])[0]
    assert parts == whole
    assert decontam.Finder(decontam.build([b"a" * 5000])).found([b"a" * 3000])[0][0]["edits"] == 0


@pytest.mark.parametrize("size", range(40, 90))
def test_words_across_a_stretch_are_whole(monkeypatch, size):
    """A stretch may end in `fox` of `foxglove`, and a tail start in `fox jumps` of `xxfox jumps`: neither is an item."""
    monkeypatch.setattr(decontam, "STRETCH", size)
    monkeypatch.setattr(decontam, "REACH", 16)
    finder = decontam.Finder(decontam.build([b"fox", b"fox jumps", b"glove"]))
    text = b"the foxglove and xxfox jumps over " * 9
    assert finder.found([text])[0] == []
    text += b"a fox jumps by a glove"
    assert [(r["item"], text[r["start"] : r["end"]]) for r in finder.found([text])[0]] == [(0, b"fox"), (1, b"fox jumps"), (2, b"glove")]
    assert [r["item"] for r in finder.found([b"fox jumps " + text[:300]])[0]] == [0, 1]


def test_blocks_of_items(spark, monkeypatch):
    rng = random.Random(7)
    items = [prose(rng, 20) for _ in range(12)]
    frame = spark.createDataFrame([(i, "so " + t) for i, t in enumerate(items)] + [(99, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 400)
    assert {(r.doc_id, r.item_id) for r in decontam.matches(frame, bench).collect()} >= {(i, i) for i in range(12)}
    assert [r.doc_id for r in decontam.clean(frame, bench).collect()] == [99]
    assert decontam.matches(frame, bench.limit(0)).count() == 0
    assert decontam.matches(frame.limit(0), bench).count() == 0
    assert decontam.clean(frame, bench.limit(0)).count() == 13
