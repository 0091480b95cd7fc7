"""Running values in segments: the rows of plain windows, and no task that holds a whole key."""

import random
from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hostlens.operators import scan
from hostlens.operators.hunt import with_parent
from hostlens.operators.replay import replay_gaps


@pytest.fixture
def many_segments(spark):
    """The range sort keeps all its partitions, as it does where they are large."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def sample(spark, n=4000, seed=1):
    """Nine of ten rows have one key; some have none, many share a time."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 45 + ["a", "b", "c", "d", None]), rng.randrange(n // 3), i, rng.choice([None, None, rng.randrange(1000)])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, seq long, v long").repartition(5)


def test_equals_plain_windows(spark, many_segments):
    rows = sample(spark)
    w = Window.partitionBy("k").orderBy("t", "seq")
    to_row, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumns({"a": F.last("v", ignorenulls=True).over(to_row), "b": F.max("v").over(to_row), "c": F.lag("t").over(w), "d": F.max("v").over(before)})
    got = scan.running(rows, ["k"], ["t", "seq"], {"a": scan.last(F.col("v")), "b": scan.most(F.col("v")), "c": scan.last(F.col("t"), before=True), "d": scan.most(F.col("v"), before=True)})
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_no_task_reads_over_twice_the_median(spark, many_segments):
    rows = sample(spark, 20_000)
    got = scan.running(rows, ["k"], ["t", "seq"], {"before": scan.last(F.struct("t"), before=True)})
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 13 and max(sizes) <= 2 * median(sizes)


def test_one_time_for_all_rows_is_cut_by_the_rest_of_the_order(spark, many_segments):
    rows = spark.range(6000).selectExpr("'k' AS k", "0L AS t", "id AS seq")
    got = scan.running(rows, ["k"], ["t", "seq"], {"before": scan.last(F.col("seq"), before=True)})
    assert got.where("NOT before <=> nullif(seq - 1, -1)").count() == 0
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 1500


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([("k", 1, 1, 5)], "k string, t long, seq long, v long")
    assert scan.running(one, ["k"], ["t", "seq"], {"a": scan.last(F.col("v"))}).first()["a"] == 5
    assert scan.running(one.limit(0), ["k"], ["t", "seq"], {"a": scan.last(F.col("v"))}).count() == 0


def test_gaps_and_parents_of_one_busy_agent(spark, many_segments):
    n = 5000
    rng = random.Random(2)
    made = [("hot" if rng.random() < 0.9 else f"a{rng.randrange(9)}", i, rng.randrange(800), rng.choice([4, 4, 4, rng.randrange(60)]), rng.choice([4, 4, rng.randrange(60)])) for i in range(n)]
    rows = spark.createDataFrame(made, "agent_id string, seq long, sec long, pid long, ppid long").withColumn("event_ts", F.timestamp_seconds("sec")).withColumn("image_path", F.format_string("i%s", "seq"))
    gaps = {r.seq: r.gap_us for r in replay_gaps(rows, 2.0).collect()}
    last, want = {}, {}
    for agent, seq, sec, _, _ in sorted(made, key=lambda r: (r[2], r[1])):
        want[seq] = (sec - last[agent]) * 500_000 if agent in last else None
        last[agent] = sec
    assert gaps == want
    seen, parents = {}, {}
    for agent, seq, _, pid, ppid in sorted(made, key=lambda r: (r[2], r[1])):
        parents[seq] = seen.get((agent, ppid))
        seen[agent, pid] = f"i{seq}"
    assert {r.seq: r.parent_image for r in with_parent(rows).collect()} == parents
