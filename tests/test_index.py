"""The index by day with sketches: what it finds, and what it reads for that."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from hostlens.operators import explain, filters
from hostlens.sources import index, sketch

from .test_operators import events, evasion, network  # noqa: F401

DAY = 24 * 60


@pytest.fixture
def indexed(events, tmp_path):  # noqa: F811
    """Ten days of events, and their index."""
    rows = [network(i, DAY * (i % 10) + i, 5 + i % 3, "1.1.1.1", f"{5 + i % 3}:{i % 10}") for i in range(1, 200)] + [evasion(i, DAY * (i % 10), 9) for i in range(200, 220)]
    table, path = events(rows), str(tmp_path / "index")
    table.write.parquet(str(tmp_path / "events"))
    table = table.sparkSession.read.parquet(str(tmp_path / "events"))
    index.rebuild(table, path)
    return table, path


def broken_except(path, days):
    """Overwrites all files of the index but those of some days; whoever reads them fails. Returns how many are left."""
    left = 0
    for part in path.glob("day=*/category=*/part-*.parquet"):
        if part.parent.parent.name.removeprefix("day=") in days:
            left += 1
        else:
            part.write_bytes(b"broken")
    return left


def test_an_id_reads_its_day_only(spark, indexed, tmp_path, monkeypatch):
    table, path = indexed
    wanted = table.where("id LIKE '00000017%'").first()
    days = index.days_of(spark, path, "event_id", wanted.id)
    assert wanted.event_ts.date() in days and len(days) <= 2
    read = spark.read.parquet(path)  # the schema, before the files go
    assert broken_except(tmp_path / "index", {str(d) for d in days}) <= 4
    monkeypatch.setattr(index, "_readable", lambda *_: read)
    assert index.event(spark, path, table, wanted.id).first().id == wanted.id
    assert filters.find_by_id(table, wanted.id).first() == index.event(spark, path, table, wanted.id).first()


def test_an_update_of_one_day_does_not_read_the_others(spark, events, indexed, tmp_path, monkeypatch):  # noqa: F811
    table, path = indexed
    day = table.agg(F.max(F.to_date("event_ts"))).first()[0]
    fresh = [network(i, DAY * 9 + i, 5, "1.1.1.1", "5:9") for i in range(600, 640)]
    again = table.where(F.to_date("event_ts") == day)
    new = events(fresh).select(*[c for c in again.columns]).unionByName(again)
    maybe = {r.day for r in sketch.may_hold_any(index._sketches(spark, path, "event_id"), index.projection(new), "event_id", ["day"]).collect()}
    assert day in maybe and len(maybe) <= 5
    before, read = spark.read.parquet(path).count(), spark.read.parquet(path)
    broken_except(tmp_path / "index", {str(d) for d in maybe})
    real = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, **o: read if p == (path,) else real(self, *p, **o))
    index.update(new, path)
    monkeypatch.undo()
    rows = sum(real(spark.read, str(d)).count() for d in (tmp_path / "index").glob(f"day={day}/category=*"))
    assert rows == again.count() + 40 and before == table.count()
    assert day in index.days_of(spark, path, "event_id", events(fresh).first().id)


@pytest.mark.parametrize("given", [
    {}, {"pid": 6}, {"process_key": "5:3"}, {"process_key": "none"}, {"category": "EVASION"}, {"severity": "high"}, {"rule": "R-1"}, {"source": "etw"}, {"source": "kernel"}, {"limit": 7},
    {"since": "2026-03-15 00:00:00"}, {"until": "2026-03-15 12:00:00", "pid": 7}, {"contains": "1.1.1.1", "limit": 3}, {"since": "2030-01-01 00:00:00"},
])
def test_queries_through_the_index_are_those_of_a_scan(spark, indexed, given):
    table, path = indexed
    want = [r.id for r in filters.query(table, **{"limit": 100} | given).collect()]
    assert [r.id for r in index.query(spark, path, table, **given).collect()] == want
    assert [r.id for r in index.query(spark, path + "-nowhere", table, **given).collect()] == want


def test_events_by_id_or_its_beginning(spark, indexed):
    table, path = indexed
    assert index.event(spark, path, table, "00000017").first().id.startswith("00000017")
    for wrong, match in (("0000", "several"), ("ffff", "no event")):
        with pytest.raises(LookupError, match=match):
            index.event(spark, path, table, wrong)
    assert index.event(spark, path + "-nowhere", table, "00000017").first().id.startswith("00000017")


def test_a_key_in_a_window_of_time(spark, indexed):
    table, path = indexed
    got = index.find(spark, path, table, "2026-03-13 00:00:00", "2026-03-16 23:59:59", process_key="5:3")
    want = table.where("process_context.process_key = '5:3' AND to_date(event_ts) <= '2026-03-16'")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.id for r in want.collect()) and want.count() > 0


def test_sketches_hold_all_and_little_else(spark):
    rng = random.Random(1)
    rows = [(f"d{i % 7}", f"v{rng.random()}") for i in range(70_000)] + [("d0", None)]
    table = spark.createDataFrame(rows, "day string, value string").cache()
    made = sketch.sketched(table, ["day"], "value").cache()
    assert made.where("length(bitmap) <> 4096").count() == 0
    found = sketch.may_hold_any(made, table.where("value IS NOT NULL"), "value", ["day"])
    assert found.join(table, ["day", "value"]).count() == 70_000
    assert found.count() < 70_000 * (1 + 6 * 0.04)
    value = rows[5][1]
    assert "d5" in {r.day for r in sketch.may_hold(made, value).collect()}
    assert {r.day for r in sketch.may_hold(made, value).collect()} == {r.day for r in found.where(F.col("value") == value).collect()}
    none = sketch.sketched(table.limit(0), ["day"], "value")
    assert none.count() == 0 and sketch.may_hold_any(none, table, "value", ["day"]).count() == 0


def test_explain_bounds_the_scan(spark, indexed):
    """The window reaches the scan as literals, not as a join."""
    table, _ = indexed
    target = table.where("id LIKE '00000017%'")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = explain.timeline(table, target, 10)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("(Hash|Merge|Loop)Join", plan) and "PushedFilters" in plan and "GreaterThanOrEqual(event_ts" in plan.replace("\n", "")
    assert explain.timeline(table, table.limit(0)).count() == 0 == explain.related(table, table.limit(0)).count()
    assert isinstance(target.first().event_ts, datetime.datetime)
