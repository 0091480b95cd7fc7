"""Streaming forms of the arrival-order operators and of the filtered tail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import arrival
from ..operators.filters import event_filter
from ..sources import sinks
from ..sources.scratch import shared_path
from .alerts import stream_alerts  # noqa: F401
from .outbox import post_once

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Walker(StatefulProcessor):
    """Keeps one object for each key between micro-batches, its FIELDS as typed state; rows of a batch go to it in order."""

    def __init__(self, make: Callable[[], object], order: list[str], schema: str, ttl_seconds: int) -> None:
        self.make, self.order, self.schema, self.ttl = make, order, schema, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("object", self.make.FIELDS, ttlDurationMs=self.ttl * 1000 or None)
        self.names = [x.split()[0] for x in self.make.FIELDS.split(", ")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.make()
        if self.state.exists():
            for name, value in zip(self.names, self.state.get()):
                setattr(held, name, value)
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = []
        for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
            out.extend(held.take(row))
        self.state.update(tuple(getattr(held, n) for n in self.names))
        parts = [x.split() for x in self.schema.split(", ")]
        yield pd.DataFrame(out, columns=[n for n, _ in parts]).astype({n: "Int64" for n, t in parts if t == "long"})

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, keys: list[str], walker: Walker, ttl: int) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return rows.groupBy(*keys).transformWithStateInPandas(walker, outputStructType=walker.schema, outputMode="Append", timeMode="ProcessingTime" if ttl else "None")


def stream_enriched(events: DataFrame, ttl_seconds: int = 0) -> DataFrame:
    """Contexts of a stream's events; a pid's state goes after ttl_seconds without an event (0: stays)."""
    return _stateful(arrival.slot_rows(events), ["agent_id", "pid"], Walker(arrival.ProcessSlot, ["seq"], arrival.CONTEXTS, ttl_seconds), ttl_seconds)


def tail(events: DataFrame, **conditions) -> DataFrame:
    """A stream's events that meet the conditions of a query (no times)."""
    return events.where(event_filter(**conditions))


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there, into a table in the shared folder, and reads that."""
    spark: SparkSession = stream.sparkSession
    out = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def follow_alerts(alerts: DataFrame, post: str | Callable[[list[dict]], None], checkpoint: str, to_end: bool = False, outbox: str | None = None, **options):
    """Starts a query that posts each alert to a URL (options are those of sinks.webhook), or gives it to a function.

    Partitions go side by side. What was posted and what failed is in an outbox (a folder beside the checkpoint
    unless given): a micro-batch that runs again posts only what was not, and outbox.resend() sends failures
    again. With to_end it ends after what is there.
    """
    if isinstance(post, str):
        post = sinks.webhook(post, **options)
    place = outbox or f"{checkpoint.rstrip('/')}-outbox"
    writer = alerts.writeStream.foreachBatch(lambda rows, number: post_once(rows, number, post, place)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if to_end else writer).start()


def deliver(lines: DataFrame, url: str, dead_path: str, checkpoint: str, size: int = 100, cap_bytes: int = 256_000_000, **options):
    """Starts a query that posts a stream's lines (value) in batches; batches that fail are kept at dead_path, up to the cap.

    A micro-batch's failures fill what room the cap leaves beside what is there; the rest is dropped.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        made = sinks.http_batches(rows.select(F.monotonically_increasing_id().alias("seq"), "value"), size).persist()
        lost = sinks.post_batches(made, url, **options).where("NOT sent").select("batch").persist()
        if not lost.isEmpty():
            failed = made.join(lost, "batch").select("batch", "body")
            there = dead_letter_table(spark, dead_path)
            used = there.agg(F.sum("bytes")).first()[0] or 0 if there is not None else 0
            kept = sinks.dead_letters(failed, max(0, cap_bytes - used)).select(F.current_timestamp().alias("batch_ts"), F.lit(number).cast("long").alias("micro_batch"), "batch", "bytes", "body")
            kept.write.mode("append").parquet(dead_path)
        made.unpersist()
        lost.unpersist()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dead_letter_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of failed batches, None where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None


def redrive(dead: DataFrame, url: str, most: int = 1000, **options) -> DataFrame:
    """Sends failed batches again, the oldest first, until one fails: (batch_ts, batch, sent). At most `most` in one go, in one task, as their order counts."""
    oldest = dead.orderBy("batch_ts", "micro_batch", "batch").limit(most).coalesce(1).sortWithinPartitions("batch_ts", "micro_batch", "batch")

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        going = True
        for frame in frames:
            sent = []
            for body in frame["body"]:
                going = going and sinks.posted(body, url, **options)[0]
                sent.append(going)
            yield frame[["batch_ts", "batch"]].assign(sent=sent)

    return oldest.mapInPandas(send, "batch_ts timestamp, batch long, sent boolean")
