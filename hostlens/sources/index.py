"""A lookup projection of events, kept as a table by day, with sketches that tell which days may hold an id or a process key."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import filters
from . import sketch
from .scratch import dropped, written

#: Columns that have sketches by day.
SKETCHED = ("event_id", "process_key")
_BLOOM = {"parquet.bloom.filter.enabled#process_key": "true", "parquet.bloom.filter.enabled#event_id": "true"}


def projection(events: DataFrame) -> DataFrame:
    """One row for each event id (the first to arrive), slim enough to look up by."""
    rows = events.select(F.col("id").alias("event_id"), "seq", "event_ts", C.event_pid(F.col("data")).alias("pid"), F.col("process_context.process_key").alias("process_key"), "category", "source_type", "source_detail", F.col("rule.id").alias("rule_id"), "severity", "severity_ord")
    names = [c for c in rows.columns if c not in ("event_id", "seq")]
    first = rows.groupBy("event_id").agg(F.min_by(F.struct("seq", *names), "seq").alias("r"))
    return first.select("event_id", "r.*")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by day and category; a day's category that is large is cut into several files, small ones share a task."""
    return rows.hint("rebalance", "day", "category").sortWithinPartitions("day", "category", "process_key", "event_ts")


def _sizes(spark: SparkSession, source: str) -> DataFrame:
    """The files of a folder and their bytes; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "length")


def rebuild(events: DataFrame, path: str, source: str | None = None) -> None:
    """Writes the projection anew, by day and category, sorted for lookups by key and time; with `source` also what it covers.

    The sizes of source files are taken first, so what is appended meanwhile counts as not covered.
    """
    covered = _covering(events.sparkSession, source)
    rows = written(projection(events).withColumn("day", F.to_date("event_ts")), "projection")
    _write(rows, path, "overwrite")
    _record(covered, path)
    dropped(rows)


def update(new_events: DataFrame, path: str, source: str | None = None) -> None:
    """Appends events whose ids are not there yet; with `source` also what is covered now.

    The sketches tell which days may hold which of the new ids; only these days are read.
    """
    spark = new_events.sparkSession
    covered = _covering(spark, source)
    rows = written(projection(new_events).withColumn("day", F.to_date("event_ts")), "projection")
    maybe = written(sketch.may_hold_any(_sketches(spark, path, "event_id"), rows, "event_id", ["day"]), "maybe")
    days = [r.day for r in maybe.select("day").distinct().collect()]  # as many as the index has days
    there = _days(spark.read.parquet(path), days).select("event_id", "day").join(maybe, ["event_id", "day"])
    fresh = written(rows.join(there, "event_id", "left_anti"), "fresh")
    _write(fresh, path, "append")
    _record(covered, path)
    dropped(rows, maybe, fresh)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """The rows by day and category, then their sketches: a sketch that is missing after a failure is mended by a rebuild."""
    writer = _dealt(rows).write
    for name, value in _BLOOM.items():
        writer = writer.option(name, value)
    writer.mode(mode).partitionBy("day", "category").parquet(path)
    for column in SKETCHED:
        sketch.sketched(rows, ["day"], column).write.mode(mode).parquet(f"{path}-sketch-{column}")


def _sketches(spark: SparkSession, path: str, column: str) -> DataFrame:
    return spark.read.parquet(f"{path}-sketch-{column}")


def _days(table: DataFrame, days: list[datetime.date]) -> DataFrame:
    """The table's partitions of some days (null is one)."""
    return table.where(F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() & F.lit(None in days)))


def days_of(spark: SparkSession, path: str, column: str, value: str) -> list[datetime.date]:
    """The days that may hold an event_id or a process_key: all that do, and about one in a hundred of the others."""
    return [r.day for r in sketch.may_hold(_sketches(spark, path, column), value).select("day").distinct().collect()]


def _covering(spark: SparkSession, source: str | None) -> DataFrame | None:
    return written(_sizes(spark, source), "covered") if source is not None else None


def _record(covered: DataFrame | None, path: str) -> None:
    if covered is not None:
        covered.write.mode("overwrite").parquet(f"{path}-covered")
        dropped(covered)


def coverage(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One row: covered_bytes, source_bytes, and whether the projection is current, that is, all of both are the same."""
    old = spark.read.parquet(f"{path}-covered").withColumnRenamed("length", "covered")
    both = _sizes(spark, source).join(old, "path", "full")
    return both.select(F.coalesce(F.sum("covered"), F.lit(0)).alias("covered_bytes"), F.coalesce(F.sum("length"), F.lit(0)).alias("source_bytes"), F.coalesce(F.every(F.col("covered").eqNullSafe(F.col("length"))), F.lit(True)).alias("is_current"))


def indexed_or_scanned(spark: SparkSession, path: str, events: DataFrame) -> DataFrame:
    """The projection where its table can be read, else that of the events; never made implicitly.

    Counting rows opens the footers of all files, so a table with a broken file is not used.
    """
    table = _readable(spark, path)
    return projection(events) if table is None else table.drop("day")


def _readable(spark: SparkSession, path: str) -> DataFrame | None:
    """The projection's table with the days, None if it or its sketches cannot be read."""
    try:
        table = spark.read.parquet(path)
        table.select(F.count("*")).first()
        for column in SKETCHED:
            _sketches(spark, path, column).first()
        return table
    except Exception:  # noqa: BLE001  a missing or broken table means a scan
        return None


def find(spark: SparkSession, path: str, events: DataFrame, since: str, until: str, pid: int | None = None, process_key: str | None = None) -> DataFrame:
    """lookup() in the projection where there is one, else in the events; the rows are the same."""
    table = _readable(spark, path)
    if table is None:
        rows = projection(events)
    else:
        rows = _days(table, days_of(spark, path, "process_key", process_key)) if process_key is not None else table
        rows = rows.where(F.col("day").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    return lookup(rows.select(*projection(events).columns), since, until, pid, process_key)


def event(spark: SparkSession, path: str, events: DataFrame, id: str) -> DataFrame:
    """filters.find_by_id() through the projection: it tells the event's id and time, and of the events only that time is read.

    A whole id is looked for in the days that may hold it, and a beginning of one in the projection. Where the
    projection cannot be read, or has no such id, the events are scanned.
    """
    table = _readable(spark, path)
    if table is None:
        return filters.find_by_id(events, id)
    found = _days(table, days_of(spark, path, "event_id", id)).where(F.col("event_id") == id).select("event_id", F.col("event_ts").cast("string").alias("at")).first()
    if found is None:
        near = table.where(F.startswith("event_id", F.lit(id))).select("event_id", F.col("event_ts").cast("string").alias("at")).limit(2).collect()
        if len(near) > 1:
            raise LookupError(f"several events begin with {id}")
        found = near[0] if near else None
    if found is None or found.at is None:
        return filters.find_by_id(events, id)
    return events.where((F.col("event_ts") == _time(events, found.at)) & (F.col("id") == found.event_id)).orderBy("seq").limit(1)


def _time(events: DataFrame, text: str) -> Column:
    return F.lit(text).cast(events.schema["event_ts"].dataType)


def query(spark: SparkSession, path: str, events: DataFrame, limit: int = 100, pid: int | None = None, process_key: str | None = None, category: str | None = None, rule: str | None = None, source: str | None = None, severity: str | None = None, since: str | None = None, until: str | None = None, contains: str | None = None) -> DataFrame:
    """filters.query() through the projection: it tells the first `limit` ids and their times, and of the events only these times are read.

    What a text holds is not in the projection, so `contains` scans the events, as everything does where the
    projection cannot be read. An id that arrived more than once is one event, the first.
    """
    given = {"pid": pid, "process_key": process_key, "category": category, "rule": rule, "source": source, "severity": severity, "since": since, "until": until, "contains": contains}
    table = _readable(spark, path) if contains is None else None
    if table is None:
        return filters.query(events, limit, **given)
    if process_key is not None:
        table = _days(table, days_of(spark, path, "process_key", process_key))
    for bound, test in ((since, F.col("day") >= F.lit(since).cast("date")), (until, F.col("day") <= F.lit(until).cast("date"))):
        table = table.where(test) if bound is not None else table
    hits = written(table.where(_conditions(**given)).orderBy("event_ts", "seq").limit(limit).select(F.col("event_id").alias("id"), "event_ts"), "hits")
    span = hits.agg(F.min("event_ts").cast("string").alias("first"), F.max("event_ts").cast("string").alias("last")).first()
    near = events.where(F.col("event_ts").between(_time(events, span.first), _time(events, span.last)))
    return near.join(F.broadcast(hits), ["id", "event_ts"], "left_semi").dropDuplicates(["id"]).orderBy("event_ts", "seq")  # at most `limit` ids


def _conditions(pid: int | None, process_key: str | None, category: str | None, rule: str | None, source: str | None, severity: str | None, since: str | None, until: str | None, contains: None) -> Column:
    """filters.event_filter() over the projection's columns."""
    test = filters.event_filter(category=category, source=source, severity=severity, since=since, until=until)
    for name, value in (("pid", pid), ("process_key", process_key), ("rule_id", rule)):
        test = test & (F.col(name) == value) if value is not None else test
    return test


def status(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"), F.max("event_ts").alias("latest"))


def lookup(index: DataFrame, since: str, until: str, pid: int | None = None, process_key: str | None = None) -> DataFrame:
    """Events of a pid or a process key in a closed range of time, in order."""
    test = F.col("process_key") == process_key if process_key is not None else F.col("pid") == pid
    near = F.col("event_ts").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz"))
    return index.where(test & near).orderBy("event_ts", "seq")
