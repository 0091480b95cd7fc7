"""Events around one event: timeline, script activity and evidence bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import columns as C


def _target(target: DataFrame) -> Row | None:
    """What is asked of the target, one row; its time as text."""
    data = F.col("data")
    return target.limit(1).select("id", F.col("event_ts").cast("string").alias("at"), F.col("process_context.process_key").alias("key"), C.acting_pid(data).alias("pid"), C.is_script_related(data).alias("script"), "agent_id").first()


def _around(events: DataFrame, t: Row | None, minutes: int, by_pid: bool) -> DataFrame:
    """events of the target's process within the window, which are literals, so that a scan of the events is bounded by them."""
    if t is None or t.at is None or t.agent_id is None or t.key is None and (not by_pid or t.pid is None):
        return events.where(F.lit(False))
    same = F.col("process_context.process_key") == t.key if t.key is not None else C.acting_pid(F.col("data")) == t.pid
    at, span = F.lit(t.at).cast(events.schema["event_ts"].dataType), F.make_dt_interval(mins=F.lit(minutes))
    return events.where(F.col("event_ts").between(at - span, at + span) & (F.col("agent_id") == t.agent_id) & same)


def timeline(events: DataFrame, target: DataFrame, minutes: int = 5) -> DataFrame:
    """Events of the target's process, by key, or by acting pid where it has no key, within the minutes on either side."""
    return _around(events, _target(target), minutes, True).orderBy("event_ts", "seq")


def script_activity(events: DataFrame, target: DataFrame, minutes: int = 5) -> DataFrame:
    """The timeline's script blocks and scans; none unless the target has to do with scripts."""
    t = _target(target)
    rows = _around(events, t if t is not None and t.script else None, minutes, True)
    return rows.where(C.is_script(F.col("data"))).orderBy("event_ts", "seq")


def script_counts(activity: DataFrame) -> DataFrame:
    kind, found = F.col("data.type"), F.col("data.scan_result") >= 32768
    return activity.agg(F.count_if(kind == "ScriptBlock").alias("script_blocks"), F.count_if(kind == "AmsiScan").alias("scans"), F.count_if((kind == "AmsiScan") & found).alias("detected"))


def related(events: DataFrame, target: DataFrame, minutes: int = 5) -> DataFrame:
    """Events with the target's process key within the window, less the target."""
    t = _target(target)
    rows = _around(events, t, minutes, False)
    return (rows.where(F.col("id") != t.id) if t is not None else rows).orderBy("event_ts", "seq")


def manifest(events: DataFrame, target: DataFrame, minutes: int = 5) -> DataFrame:
    """One row on a bundle of the target and its related events: format, ids, window, count and time range."""
    one = target.limit(1).select("id", "event_ts")
    rows = related(events, target, minutes).select("id", "event_ts").unionByName(one)
    return rows.agg(F.lit("evidence-bundle").alias("format"), F.lit(1).alias("version"), F.lit(minutes).alias("window_minutes"), F.count("*").alias("event_count"), F.min("event_ts").alias("earliest"), F.max("event_ts").alias("latest")).crossJoin(F.broadcast(one.select(F.col("id").alias("target_id"))))


def write_bundle(events: DataFrame, target: DataFrame, path: str, minutes: int = 5) -> None:
    """Writes target, related events and manifest as JSON below a path."""
    target.limit(1).write.json(f"{path}/target")
    related(events, target, minutes).write.json(f"{path}/related")
    manifest(events, target, minutes).write.json(f"{path}/manifest")
