"""Trees against a walk in plain Python: deep chains, many roots, roots below roots, cycles."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hostlens.operators import tree

from .test_operators import create, events  # noqa: F401

EDGE = "agent_id long, seq long, event_ts timestamp_ntz, pid long, ppid long, pkey string, image_path string, parent_seq long"


def edge_rows(parents):
    return [(1, seq, None, seq + 10, (parent if parent is not None else -seq) + 10, None, None, parent) for seq, parent in parents.items()]


def plain_down(parents, roots):
    below = {}
    for seq, parent in parents.items():
        below.setdefault(parent, []).append(seq)
    out = set()
    for root in roots:
        todo, seen = [(root, 0)], {root}
        while todo:
            seq, depth = todo.pop()
            out.add((root, seq, depth))
            for child in below.get(seq, []):
                if child not in seen:
                    seen.add(child)
                    todo.append((child, depth + 1))
    return out


def plain_up(parents, roots):
    out = set()
    for root in roots:
        seq, depth, seen = root, 0, set()
        while seq is not None and seq not in seen:
            seen.add(seq)
            out.add((root, seq, depth))
            seq, depth = parents[seq], depth + 1
    return out


def frames(spark, parents, roots):
    return spark.createDataFrame(edge_rows(parents), EDGE), spark.createDataFrame([(r,) for r in roots], "seq long")


@pytest.mark.parametrize("seed", range(4))
def test_random_trees_with_cycles_and_nested_roots(spark, seed):
    rng = random.Random(seed)
    parents = {i: rng.choice([None, rng.randrange(80)]) if rng.random() < 0.3 else max(0, i - rng.randrange(1, 5)) for i in range(80)}
    parents = {i: p if p != i else None for i, p in parents.items()}
    roots = rng.sample(range(80), 12) + [5, 5]
    edge, marked = frames(spark, parents, roots)
    down = tree.descendants(edge, marked).collect()
    assert {(r.root, r.seq, r.depth) for r in down} == plain_down(parents, set(roots)) and len(down) == len(set(down))
    assert all(r.pid == r.seq + 10 for r in down)
    up = tree.ancestors(edge, marked).collect()
    assert {(r.root, r.seq, r.depth) for r in up} == plain_up(parents, set(roots)) and len(up) == len(set(up))


def test_a_chain_of_a_thousand(spark):
    parents = {0: None} | {i: i - 1 for i in range(1, 1000)}
    edge, marked = frames(spark, parents, [0, 400])
    rows = tree.descendants(edge, marked).collect()
    assert len(rows) == 1600 and max(r.depth for r in rows) == 999
    edge, marked = frames(spark, parents, [999])
    assert sorted(r.depth for r in tree.ancestors(edge, marked).collect()) == list(range(1000))


def plain_preorder(parents, times, roots):
    below = {}
    for seq in sorted(parents, key=lambda s: (times[s], s)):
        below.setdefault(parents[seq], []).append(seq)
    out = []
    for root in roots:
        todo, seen, place = [(root, 0)], {root}, 0
        while todo:
            seq, depth = todo.pop()
            place += 1
            out.append((root, seq, depth, place))
            children = [c for c in below.get(seq, []) if c not in seen]
            seen |= set(children)
            todo += [(c, depth + 1) for c in reversed(children)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_preorder_and_text_of_random_trees(spark, seed):
    rng = random.Random(seed)
    parents = {i: None if rng.random() < 0.1 else max(0, i - rng.randrange(1, 9)) for i in range(1, 120)} | {0: None}
    times = {i: rng.randrange(6) for i in parents}
    edge, marked = frames(spark, parents, [i for i, p in parents.items() if p is None] + [50, 51])
    edge = edge.withColumn("event_ts", F.timestamp_seconds(F.element_at(F.create_map(*[F.lit(x) for pair in times.items() for x in pair]), F.col("seq").cast("int"))).cast("timestamp_ntz"))
    down = tree.descendants(edge, marked)
    roots = {r.seq for r in marked.collect()}
    assert sorted(map(tuple, tree.preorder(down, edge).collect())) == plain_preorder(parents, times, roots)
    events = edge.select("seq", "event_ts", F.struct(F.lit("ProcessCreate").alias("type"), "pid", "ppid", F.lit('a "b"').alias("image_path"), F.lit(None).cast("string").alias("command_line"), F.lit("u").alias("user")).alias("data"), F.struct(F.col("pkey").alias("process_key")).alias("process_context"))
    texts = {r.root: json.loads(r.json) for r in tree.as_json(down, edge, events).collect()}

    def listed(node, depth=0):
        yield node["pid"] - 10, depth
        for child in node.get("children", []):
            yield from listed(child, depth + 1)

    for root in roots:
        assert list(listed(texts[root])) == [(s, d) for r, s, d, _ in sorted(plain_preorder(parents, times, [root]), key=lambda x: x[3])]


def test_a_chain_of_a_thousand_as_text(spark):
    parents = {0: None} | {i: i - 1 for i in range(1, 1000)}
    edge, marked = frames(spark, parents, [0])
    down = tree.descendants(edge, marked)
    assert [r.seq for r in tree.preorder(down, edge).orderBy("place").collect()] == list(range(1000))
    events = edge.select("seq", "event_ts", F.struct(F.lit("ProcessCreate").alias("type"), "pid", "ppid", "image_path", F.lit("").alias("command_line"), F.lit("u").alias("user")).alias("data"), F.struct(F.col("pkey").alias("process_key")).alias("process_context"))
    text = tree.as_json(down, edge, events).first().json
    assert text.count('"children":[') == 999 and text.endswith("}" + "]}" * 999)


def test_over_a_million_rows(spark):
    """A third are roots, the others hang below them by one or two steps."""
    seq = F.col("id")
    parent = F.when(seq % 3 > 0, seq - 1)
    none = F.lit(None).cast("string")
    edge = spark.range(1_200_000).select(F.lit(1).alias("agent_id"), seq.alias("seq"), seq.alias("pid"), F.coalesce(parent, F.lit(-1)).alias("ppid"), none.alias("pkey"), parent.alias("parent_seq"))
    rows = tree.descendants(edge, edge.where("parent_seq IS NULL").select("seq"))
    assert [tuple(r) for r in rows.groupBy("depth").count().orderBy("depth").collect()] == [(0, 400_000), (1, 400_000), (2, 400_000)]


def test_empty(spark):
    edge, marked = frames(spark, {1: None}, [1])
    assert tree.descendants(edge.limit(0), marked).count() == 0
    assert tree.descendants(edge, marked.limit(0)).count() == 0
    assert tree.ancestors(edge, marked.limit(0)).count() == 0


def test_an_unknown_process_is_an_error(spark):
    from hostlens.sources.telemetry import telemetry

    events = telemetry(spark, "/root/testdata/sf0.001")
    assert tree.roots_of(events, pid=7).count() > 0
    with pytest.raises(LookupError, match="pid 123456"):
        tree.roots_of(events, pid=123456)
    with pytest.raises(LookupError, match="key nobody"):
        tree.roots_of(events, process_key="nobody")


def test_edges_make_their_creations_once(spark, events):  # noqa: F811
    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(id):
        made.add(1)
        return True

    rows = events([create(i, i, i, i - 1, "a.exe") for i in range(1, 21)])
    assert tree.edges(rows.where(counted("id"))).count() == 20
    assert made.value == 20
