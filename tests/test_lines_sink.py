"""A sink of lines: rotation by bytes, numbers that go on, commits that show all or nothing."""

import json
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from hostlens.plans import queries
from hostlens.sources import jsonl
from hostlens.sources.lines_sink import STAGING, RotatedLines, StreamWriter, Written

from .test_operators import events, network  # noqa: F401


def lines(spark, n, parts=1, size=20):
    spark.dataSource.register(RotatedLines)
    return spark.range(0, n, 1, parts).select(F.rpad(F.col("id").cast("string"), size - 1, "x").alias("value"))


def put(rows, path, rotation):
    rows.write.format("rotated_lines").option("rotation_bytes", rotation).mode("append").save(str(path))


def files(path):
    """Lines by file name of all that is shown."""
    found = {}
    for top, _, names in os.walk(path):
        if STAGING not in top:
            found |= {n: open(os.path.join(top, n)).read().splitlines() for n in names}
    return found


def test_rotation_makes_numbered_files(spark, tmp_path):
    put(lines(spark, 3), tmp_path, 2 * 20 + 1)
    assert {n: len(x) for n, x in files(tmp_path).items()} == {"events.jsonl.1": 2, "events.jsonl.2": 1}


def test_no_rotation_at_zero(spark, tmp_path):
    put(lines(spark, 500), tmp_path, 0)
    assert {n: len(x) for n, x in files(tmp_path).items()} == {"events.jsonl.1": 500}


def test_numbers_go_on_from_what_is_there(spark, tmp_path):
    for name in ("events.jsonl.1", "events.jsonl.3", "events.jsonl", "events.jsonl.old"):
        (tmp_path / name).write_text("old\n")
    put(lines(spark, 2), tmp_path, 10)
    put(lines(spark, 1), tmp_path, 10)
    assert set(files(tmp_path)) == {"events.jsonl", "events.jsonl.old", "events.jsonl.1", "events.jsonl.3", "events.jsonl.4", "events.jsonl.5", "events.jsonl.6"}
    assert files(tmp_path)["events.jsonl.3"] == ["old"]


def test_files_are_below_the_limit_and_hold_each_line_once(spark, tmp_path):
    rows = spark.range(0, 900, 1, 3).select(F.expr("repeat('é', cast(id % 40 as int))").alias("value"))
    spark.dataSource.register(RotatedLines)
    put(rows, tmp_path, 100)
    found = files(tmp_path)
    assert sorted(x for f in found.values() for x in f) == sorted("é" * (i % 40) for i in range(900))
    assert all(sum(len(x.encode()) + 1 for x in f) < 100 for f in found.values())
    assert sorted(int(n.rpartition(".")[2]) for n in found) == list(range(1, len(found) + 1))
    in_order = [x for n in sorted(found, key=lambda n: int(n.rpartition(".")[2])) for x in found[n]]
    assert in_order == ["é" * (i % 40) for i in range(900)], "numbers follow partitions and rows"
    put(lines(spark, 2, size=300), tmp_path / "long", 100)
    assert [len(x) for x in files(tmp_path / "long").values()] == [1, 1]


def test_rotated_files_are_valid_events(spark, events, tmp_path):  # noqa: F811
    jsonl.write_lines(events([network(i, i % 50, 5, "1.1.1.1") for i in range(1, 11)]), str(tmp_path), 900)
    found = files(tmp_path)
    assert len(found) >= 3 and all(json.loads(x)["hostname"] for f in found.values() for x in f)
    assert jsonl.read_events(spark, str(tmp_path)).count() == 10


def test_a_write_that_fails_shows_nothing(spark, tmp_path):
    put(lines(spark, 5), tmp_path, 0)
    bad = lines(spark, 100, 4).select(F.when(F.col("value").startswith("99"), F.raise_error(F.lit("stop"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception, match="stop"):
        put(bad, tmp_path, 30)
    assert list(files(tmp_path)) == ["events.jsonl.1"]
    with pytest.raises(Exception, match="appends"):
        lines(spark, 1).write.format("rotated_lines").mode("overwrite").save(str(tmp_path))


def test_a_micro_batch_that_runs_again_shows_once(tmp_path):
    def stage(writer):
        os.makedirs(tmp_path / writer.staging, exist_ok=True)
        name = uuid.uuid4().hex
        (tmp_path / writer.staging / name).write_text("a\n")
        return [Written(0, [(name, 1, 2)]), None]

    first = StreamWriter(str(tmp_path), "events.jsonl", 0, "q")
    first.commit(stage(first), 0)
    again = StreamWriter(str(tmp_path), "events.jsonl", 0, "q")
    again.commit(stage(again), 0)
    assert list(files(tmp_path)) == ["events.jsonl.1"]
    again.commit(stage(again), 1)
    other = StreamWriter(str(tmp_path), "events.jsonl", 0, "another")
    other.commit(stage(other), 0)
    assert sorted(files(tmp_path)) == ["events.jsonl.1", "events.jsonl.2", "events.jsonl.3"]


def test_a_stream_is_written_through(spark, events, tmp_path):  # noqa: F811
    jsonl.write_lines(events([network(i, i, 5, "1.1.1.1") for i in range(1, 7)]), str(tmp_path / "in"), 700)
    for _ in range(2):
        stream = jsonl.stream_events(spark, str(tmp_path / "in"))
        jsonl.stream_lines(stream, str(tmp_path / "out"), str(tmp_path / "check"), 700).trigger(availableNow=True).start().awaitTermination()
    out = jsonl.read_events(spark, str(tmp_path / "out"))
    assert sorted(r.id for r in out.collect()) == sorted(r.id for r in jsonl.read_events(spark, str(tmp_path / "in")).collect())
    assert all(n.startswith("events.jsonl.") for n in files(tmp_path / "out"))


def test_methods_of_the_parse_are_small_enough_for_the_jvm_to_compile(spark):
    rows = jsonl.parsed(spark.createDataFrame([("{}",)], "value string"))
    for frame in (rows, queries._facts(rows), jsonl.as_lines(rows)):
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(frame._jdf.queryExecution().executedPlan())
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        assert sizes and max(sizes) < 8000, "the JVM leaves methods from 8000 bytes on to its interpreter"


def test_the_lines_are_made_in_one_pass(spark, tmp_path):
    spark.range(100).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts", "id % 5 AS user_id", "'signup' AS event_type", "concat('{\"k\": ', id, '}') AS props").write.parquet(str(tmp_path / "events.parquet"))
    lines = queries._lines(spark, str(tmp_path))
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    values = [r.value for r in lines.collect()]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(queries._lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
    assert len(values) == 110 and values.count("") == 5 and values.count('{"id": "x", "data": {') == 5


def test_a_backslash_before_a_slash_stays(spark, events, tmp_path):  # noqa: F811
    row = network(1, 1, 5, "1.1.1.1")
    rows = events([row]).withColumn("hostname", F.lit("C:\\/x/y"))
    jsonl.write_lines(rows, str(tmp_path), 0)
    assert [r.hostname for r in jsonl.read_events(spark, str(tmp_path)).collect()] == ["C:\\/x/y"]
