import random
import re
from itertools import permutations

import pytest

from hostlens.llm import audit

COLUMNS = ["part", "filter_order", "step", "filter", "kept", "removed", "good_lost", "toxic_lost", "redundant", "unique_fails", "shapley"]


def plain(docs, labels):
    """All orders applied to all documents, one after another."""
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(smallest.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= x <= "Z" for x in text) > 3 * len(text),
            "D": bool(set(text) & set("#$%&*|")), "E": i is not None and smallest[text] < i,
        }
        rows.append((lang or "", fails, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)))
    out = []
    for part in {r[0] for r in rows}:
        mine, removals = [r for r in rows if r[0] == part], {}
        lines = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                removals[f] = removals.get(f, 0) + len(gone)
                failing = sum(r[1][f] for r in mine)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                lines.append([part, "".join(order), step + 1, f, len(left), len(gone), sum(r[2] for r in gone), sum(r[3] for r in gone), failing - len(gone), alone])
        out += [tuple([*x, removals[x[3]]]) for x in lines]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_equals_filters_applied_in_turn(spark, seed):
    rng = random.Random(seed)
    prose = lambda n, k: " ".join(rng.choice(["A", "über", "the", "x#", "|", "of"] if rng.random() < 0.1 else [f"w{rng.randrange(k)}"]) for _ in range(n))
    texts = [prose(rng.choice([3, 199, 200, 260]), rng.choice([5, 90, 900])) for _ in range(25)] + [None, "", "", "  ", "ABC", "a" * 97 + "ABC", "a" * 96 + "ABCD", "ab " * 199 + "é"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(None, texts[0], "en"), (None, texts[0], "en"), docs[5], docs[5], (docs[6][0], texts[3], "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, mask int, n long").repartition(3)
    got = audit.filter_audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == plain(docs, labels)


def test_a_table_of_one_text(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'Same #text' AS text", "'en' AS lang")
    counts = audit.masks(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted((r["mask"], r["n"]) for r in counts.collect()) == [(0b01101, 1), (0b11101, 2999)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.filter_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_swaps_go_through_all_orders():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in audit.neighbour_swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n)))) == len(audit.neighbour_swaps(n)) + 1


def test_equal_nodes_are_shared_after_any_swap():
    rng = random.Random(1)
    counts = {m: (rng.randrange(3), 0, 0) for m in range(64)}
    diagram = audit.Diagram("ABCDEF", counts)
    for _ in range(300):
        diagram.swap(rng.randrange(5))
        for level in diagram.levels:
            assert len(set(level.values())) == len(level)
        fresh = audit.Diagram(diagram.order, {sum(1 << diagram.order.index(x) for k, x in enumerate("ABCDEF") if m >> k & 1): w for m, w in counts.items()})
        assert [len(x) for x in fresh.levels] == [len(x) for x in diagram.levels]
        assert list(fresh.steps()) == list(diagram.steps())
