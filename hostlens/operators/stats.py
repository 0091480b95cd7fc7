"""Summary statistics of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def totals(events: DataFrame) -> DataFrame:
    """Number of events, earliest and latest time, and whole hours and minutes between (null when empty)."""
    out = events.agg(F.count("*").alias("total_events"), F.min("event_ts").alias("earliest"), F.max("event_ts").alias("latest"))
    minutes = F.timestamp_diff("MINUTE", F.col("earliest"), F.col("latest"))
    return out.select("*", F.floor(minutes / 60).cast("long").alias("hours"), (minutes % 60).cast("long").alias("minutes"))


def _counts(events: DataFrame, label) -> DataFrame:
    return events.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def by_category(events: DataFrame) -> DataFrame:
    return _counts(events, F.col("category")).orderBy(F.desc("n"), "label")


def by_severity(events: DataFrame) -> DataFrame:
    """From the gravest down."""
    return _counts(events, F.col("severity")).orderBy(F.desc(C.severity_ord(F.col("label"))))


def by_source(events: DataFrame) -> DataFrame:
    return _counts(events, C.source_label(F.col("source_type"), F.col("source_detail"))).orderBy(F.desc("n"), "label")


def by_rule(events: DataFrame) -> DataFrame:
    return _counts(events.where("rule IS NOT NULL"), F.col("rule.id")).orderBy(F.desc("n"), "label")


def top_processes(events: DataFrame, limit: int = 10) -> DataFrame:
    """Processes with the most events: the pid seen first, the image that a context told first."""
    rows = events.select(C.effective_key(F.col("process_context"), F.col("data")).alias("pkey"), C.event_pid(F.col("data")).alias("pid"), F.col("process_context.image_path").alias("image"), "seq").where("pid IS NOT NULL")
    out = rows.groupBy("pkey").agg(F.min_by("pid", "seq").alias("pid"), F.expr("min_by(image, seq) FILTER (WHERE image IS NOT NULL)").alias("image"), F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "pkey").limit(limit)
