"""Event filters; all that are given must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def source_is(text: str) -> Column:
    """etw or part of a provider's name, sysmon, evasion (or evasiondetector), sensor; in any case."""
    low = text.lower()
    kind = F.col("source_type")
    etw = F.lit(low == "etw") | F.contains(F.lower("source_detail"), F.lit(low))
    named = (kind == "sysmon") & F.lit(low == "sysmon") | (kind == "evasion") & F.lit(low in ("evasion", "evasiondetector")) | (kind == "sensor") & F.lit(low == "sensor")
    return F.coalesce((kind == "etw") & etw, F.lit(False)) | named


def event_filter(pid: int | None = None, process_key: str | None = None, category: str | None = None, rule: str | None = None, source: str | None = None, severity: str | None = None, contains: str | None = None, since: str | None = None, until: str | None = None, time: str = "event_ts") -> Column:
    """The conjunction of the given conditions; times are inclusive."""
    tests = [F.lit(True)]
    if pid is not None:
        tests.append(C.event_pid(F.col("data")) == pid)
    if process_key is not None:
        tests.append(F.col("process_context.process_key") == process_key)
    if category is not None:
        tests.append(F.lower("category") == category.lower())
    if rule is not None:
        tests.append(F.col("rule.id") == rule)
    if source is not None:
        tests.append(source_is(source))
    if severity is not None:
        tests.append(F.col("severity_ord") >= C.parse_severity(severity))
    if contains is not None:
        tests.append(C.text_contains(F.col("raw"), contains))
    if since is not None:
        tests.append(F.col(time) >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        tests.append(F.col(time) <= F.lit(until).cast("timestamp_ntz"))
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def query(events: DataFrame, limit: int | None = 100, **conditions) -> DataFrame:
    """Events that meet the conditions, by time and arrival, at most `limit`."""
    rows = events.where(event_filter(**conditions))
    return rows.orderBy("event_ts", "seq").limit(limit) if limit is not None else rows


def find_by_id(events: DataFrame, id: str) -> DataFrame:
    """The event of an id, or else the one whose id begins so; none or several are an error. Two rows at most reach the driver."""
    exact = events.where(F.col("id") == id)
    if not exact.isEmpty():
        return exact.orderBy("seq").limit(1)
    near = events.where(F.startswith("id", F.lit(id)))
    found = near.select("id").distinct().limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"no event {id}" if not found else f"several events begin with {id}")
    return near.orderBy("seq").limit(1)
