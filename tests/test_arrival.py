"""Windows over a history against the walks that a stream takes, on random events."""

import random

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from hostlens.operators import arrival
from hostlens.sources.rules import Rules
from hostlens.streaming import jobs

from .plain_alerts import AgentAlerts
from .test_operators import create, evasion, event, events, load, network  # noqa: F401


@pytest.mark.parametrize("wait", [0, 1, 7, 60])
def test_passing_against_a_walk(wait):
    rng = random.Random(wait)
    for n in (0, 1, 5, 300):
        at = np.array([rng.randrange(200) + rng.choice((0, 0.1, 0.3)) for _ in range(n)])
        for last in (None, 20.0):
            want, now = [], last
            for x in at:
                want.append(now is None or x - now >= wait)
                now = x if want[-1] else now
            keep, end = arrival.passing(at, last, wait)
            assert keep.tolist() == want and end == now


def test_cooled_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(1)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.choice("xy"), i, float(rng.randrange(500))) for i in range(400)]
    frame = spark.createDataFrame(rows, "agent_id string, dedup string, seq long, t double").repartition(5)
    got = {r.seq for r in arrival.cooled(frame, 20, order=["seq"], time=F.col("t")).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = set(), {}
    for agent, dedup, seq, t in rows:
        if (agent, dedup) not in last or t - last[agent, dedup] >= 20:
            last[agent, dedup] = t
            want.add(seq)
    assert got == want


def _random_events(rng, n):
    out = []
    for i in range(1, n):
        pid, minute = rng.randrange(1, 6), rng.randrange(50)
        key = f"{pid}:{rng.randrange(2)}" if rng.random() < 0.5 else None
        kind = rng.randrange(6)
        if kind < 2:
            out.append(create(i, minute, pid, rng.randrange(1, 6), rng.choice(["C:\\o\\winword.exe", "cmd.exe", "certutil.exe", "a.exe", ""]), key, time=rng.choice([None, None, 0, 1, 2])))
        elif kind == 2:
            out.append(evasion(i, minute, rng.choice([pid, None]), key=key))
        elif kind == 3:
            out.append(network(i, minute, pid, rng.choice(["8.8.8.8", "9.9.9.9", "10.0.0.1"]), key))
        elif kind == 4:
            out.append(load(i, minute, pid, rng.choice(["x.dll", "y.dll"]), rng.random() < 0.3, key))
        else:
            out.append(event(i, minute, {"type": "ProcessTerminate", "pid": pid, "image_path": "a", "create_time": rng.choice([None, 0, 1, 2])}))
    return out


def test_contexts_against_the_walk(events):  # noqa: F811
    read = events(_random_events(random.Random(5), 250)).cache()
    slots, want = {}, {}
    for r in sorted(arrival.slot_rows(read).collect(), key=lambda r: r.seq):
        for seq, key, image in slots.setdefault((r.agent_id, r.pid), arrival.ProcessSlot()).take(r.asDict()):
            want[seq] = key, image
    assert {r.seq: (r.context_key, r.context_image) for r in arrival.enriched(read).collect()} == want


@pytest.mark.parametrize("order", ["seq", "at"])
def test_alerts_against_the_walk(events, order):  # noqa: F811
    rules = Rules(cooldown=300, threshold=25)
    read = events(_random_events(random.Random(6), 250)).cache()
    agents, want = {}, []
    rows = [r.asDict() for r in arrival.alert_rows(read).collect()]
    for r in sorted(rows, key=lambda r: (r[order], r["seq"])):
        want += agents.setdefault(r["agent_id"], AgentAlerts(rules)).take(r)
    got = [tuple(r) for r in arrival.backtest(read, rules, order).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 30


@pytest.fixture
def batches(spark, tmp_path):
    """Runs stream_alerts over parts of a table, one micro-batch after another; gives the alerts and each batch's progress."""

    def run(parts, rules):
        source, query = str(tmp_path / "in"), None
        for i, part in enumerate(parts):
            part.coalesce(1).write.mode("append").parquet(source)
            if query is None:
                stream = spark.readStream.schema(part.schema).parquet(source)
                query = jobs.stream_alerts(stream, rules).writeStream.format("memory").queryName("alerts_of_parts").option("checkpointLocation", str(tmp_path / "check")).start()
            query.processAllAvailable()
        progress = [p for p in query.recentProgress if p["numInputRows"]]
        rows = [tuple(r) for r in spark.table("alerts_of_parts").collect()]
        query.stop()
        return rows, progress

    return run


@pytest.mark.parametrize("cuts", [[], [60, 110, 111, 200]])
def test_stream_alerts_against_the_walk(events, batches, cuts):  # noqa: F811
    """The same alerts, whether the events come in one micro-batch or in five."""
    rules = Rules(cooldown=300, threshold=25)
    read = events(_random_events(random.Random(6), 250)).cache()
    want, agents = [], {}
    rows = sorted((r.asDict() for r in arrival.alert_rows(read).collect()), key=lambda r: r["seq"])
    for r in rows:
        want += agents.setdefault(r["agent_id"], AgentAlerts(rules)).take(r)
    order = sorted(r.seq for r in read.select("seq").collect())
    bounds = [order[0], *[order[c] for c in cuts], order[-1] + 1]
    got, _ = batches([read.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(bounds, bounds[1:])], rules)
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 30


def test_state_writes_do_not_grow_with_an_agents_age(events, batches):  # noqa: F811
    """Each micro-batch brings 40 new addresses of one process: what it writes stays the same."""
    made, n = [], 1
    for batch in range(4):
        made.append([network(n + i, batch, 7, f"8.{batch}.0.{i}", "7:1") for i in range(40)])
        n += 40
    read = events([e for part in made for e in part]).cache()
    first = read.agg(F.min("seq")).first()[0]
    parts = [read.where((F.col("seq") >= first + 40 * i) & (F.col("seq") < first + 40 * i + 40)) for i in range(4)]
    _, progress = batches(parts, Rules(cooldown=10**6, threshold=10**6))
    writes = [sum(o["numRowsUpdated"] for o in p["stateOperators"]) for p in progress]
    total = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    assert len(writes) == 4 and total[-1] >= 160 and max(writes[1:]) <= writes[0]


@pytest.mark.parametrize("wait", [0, 1, 7, 60])
def test_last_passes_against_passing(wait):
    rng = random.Random(wait)
    for n in (1, 2, 9, 300):
        at = np.array([rng.randrange(200) + rng.choice((0, 0.1, 0.3)) for _ in range(n)])
        bounds, ends = arrival.last_passes(at, wait)
        assert (np.diff(bounds) > 0).all() and (np.diff(ends) > 0).all()
        assert arrival.passing(at, None, wait)[1] == ends[0]
        for last in [rng.randrange(-80, 210) + 0.2 for _ in range(40)]:
            later = np.flatnonzero(bounds - last >= wait)
            assert arrival.passing(at, last, wait)[1] == (ends[later[0]] if len(later) else last)


def test_one_hot_key_is_cooled_in_many_tasks(spark):
    """Nine of ten rows have one key; each segment is a task, and the rows that pass are those of one walk."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", i, float(i // 3 + rng.choice([0, 0, 9, -4]))) for i in range(6000)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, "agent_id string, seq long, at double").withColumn("dedup", F.lit(None).cast("string")).repartition(3)
        for wait in (0, 5, 40, 5000):
            got = arrival.cooled(table, wait, order=["seq"], time=F.col("at"))
            want = []
            for key in {r[0] for r in rows}:
                mine = [r for r in rows if r[0] == key]
                want += [r[1] for r, keep in zip(mine, arrival.passing(np.array([r[2] for r in mine]), None, wait)[0]) if keep]
            assert sorted(r.seq for r in got.collect()) == sorted(want)
        tasks = arrival.cooled(table, 0, order=["seq"], time=F.col("at")).where("agent_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 2500
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_segments_of_a_cooldown_are_folded_in_many_tasks(spark, tmp_path, monkeypatch):
    fold, seen = arrival._fold, tmp_path / "tasks"
    seen.mkdir()

    def watched(wait):
        def of(batches):
            (seen / str(TaskContext.get().partitionId())).touch()
            return fold(wait)(batches)

        return of

    monkeypatch.setattr(arrival, "_fold", watched)
    rows = spark.range(0, 40_000, 1, 4).selectExpr("id AS seq", "1L AS agent_id", "concat('k', id % 50) AS dedup", "timestamp_seconds(id) AS event_ts")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert arrival.cooled(rows, 300.0).count() > 50
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(seen.iterdir())) > 1
