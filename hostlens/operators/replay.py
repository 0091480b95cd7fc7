"""Events in time order, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import scan


def replay_order(events: DataFrame) -> DataFrame:
    return events.orderBy("event_ts", "seq")


def replay_places(events: DataFrame) -> DataFrame:
    """Events in time order with place, from 1: a range sort, and the numbers of rows in the partitions before.

    The sorted rows are written with their partition and their row in it, so the two cannot differ; the
    table of partitions has a row for each and is all that one task sees.
    """
    at = F.monotonically_increasing_id()
    rows = written(replay_order(events).withColumn("place", at), "replay")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    parts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    joined = rows.withColumn("part", part).join(F.broadcast(parts), "part")
    return joined.withColumn("place", F.col("before") + row + 1).select(rows.columns)


def replay_gaps(events: DataFrame, speed: float = 1.0) -> DataFrame:
    """Events with gap_us, the microseconds since the agent's event before, divided by the speed (null for its first).

    The event before comes from a scan in segments, so an agent of any number of events is spread. Only times go
    through the scan; the gaps are joined to the events by seq, which no two events share.
    """
    if speed <= 0:
        raise ValueError("speed must be above 0")
    times = events.select("agent_id", "event_ts", "seq")
    rows = scan.running(times, ["agent_id"], ["event_ts", "seq"], {"before": scan.last(F.struct("event_ts"), before=True)})
    micros = F.timestamp_diff("MICROSECOND", F.col("before.event_ts"), F.col("event_ts"))
    gaps = rows.select("seq", F.floor(micros / F.lit(speed)).cast("long").alias("gap_us"))
    return events.join(gaps, "seq").select(*events.columns, "gap_us")
