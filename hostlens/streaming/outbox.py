"""An outbox of alerts: what was posted and what failed, so that a micro-batch that runs again posts no alert twice.

The outbox is a folder of JSON lines, `batch=N` for each micro-batch: (id, sent, alert, run). An alert's id is a
digest of its facts, and of its number among equal ones; run is the run of a task that posted it. A task records
each CHUNK of alerts as soon as it has posted them, in a file of its own under `_open`, so an executor that is lost
leaves at most one chunk a task unrecorded; receivers can tell those by the id, which is posted as alert_id. Chunks of
MERGED bytes, and those that are left at a task's end, become one file of the micro-batch, so that readers open few files; then
they are deleted. What a lost task leaves under `_open` is read from there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: Alerts that are posted before they are recorded together.
CHUNK = 50
#: Bytes of records that a task holds before they become a file.
MERGED = 8_000_000
OPEN = "_open"
_SCHEMA = "id string, sent boolean, alert string, run string"

Post = Callable[[list[dict]], None]


def identified(alerts: DataFrame) -> DataFrame:
    """alerts with alert_id."""
    facts = F.to_json(F.struct(*[F.col(f"`{c}`") for c in alerts.columns]))
    number = F.row_number().over(Window.partitionBy("alert_id").orderBy("alert_id"))
    return alerts.withColumn("alert_id", F.sha2(facts, 256)).withColumn("alert_id", F.concat_ws("-", "alert_id", number.cast("string")))


def records(spark: SparkSession, outbox: str, batch: int | None = None) -> DataFrame:
    """All records (id, sent, alert, run, batch), or those of one micro-batch, whose folder alone is read beside open chunks.

    A task that is lost while it deletes merged chunks leaves these twice; states() counts them once.
    """
    system, root = fs.FileSystem.from_uri(outbox)
    schema = f"{_SCHEMA}, batch long"

    def read(base: str, place: str = "") -> DataFrame | None:
        if system.get_file_info(f"{root}{base}{place}").type == fs.FileType.NotFound:
            return None
        # A running task may merge chunks after they are listed.
        reader = spark.read.schema(schema).option("basePath", f"{outbox}{base}").option("ignoreMissingFiles", base != "")
        return reader.json(f"{outbox}{base}{place}").select("id", "sent", "alert", "run", "batch")

    left = read(f"/{OPEN}")  # listed first, so that what is merged meanwhile is found in the folder
    if left is not None and batch is not None:
        left = left.where(F.col("batch") == batch)
    found = [x for x in (read("", "" if batch is None else f"/batch={batch}"), left) if x is not None]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def states(recorded: DataFrame) -> DataFrame:
    """One row an alert: (batch, id, sent, attempts, alert); sent if any attempt was. Records without a run are an attempt each."""
    attempts = (F.count_if(F.col("run").isNull()) + F.size(F.collect_set("run"))).cast("long")
    return recorded.groupBy("batch", "id").agg(F.max("sent").alias("sent"), attempts.alias("attempts"), F.min("alert").alias("alert"))


def _sender(post: Post, outbox: str) -> Callable[[Iterable[Row]], None]:
    """Posts a partition's rows (batch, alert_id, and the alert's facts or its text) and records them."""

    def send(rows: Iterable[Row]) -> None:
        system, root = fs.FileSystem.from_uri(outbox)
        run = uuid.uuid4().hex
        done: list[tuple[int, str]] = []
        held: list[tuple[int, str]] = []
        size = merged = 0

        def write(records: list[tuple[int, str]], place: str, name: str, whole: bool = False) -> None:
            texts: dict[int, list[str]] = {}
            for batch, text in records:
                texts.setdefault(batch, []).append(text)
            for batch, lines in texts.items():
                folder = f"{place}/batch={batch}"
                system.create_dir(folder)
                first = f"{folder}/_{name}" if whole else f"{folder}/{name}.json"
                with system.open_output_stream(first) as file:
                    file.write("".join(lines).encode())
                if whole:  # hidden until then
                    system.move(first, f"{folder}/{name}.json")

        def record() -> None:
            nonlocal done, size
            write(done, f"{root}/{OPEN}/part={run}-{merged}", uuid.uuid4().hex)
            held.extend(done)
            size += sum(len(text) for _, text in done)
            done = []

        def merge() -> None:
            nonlocal held, size, merged
            write(held, root, f"{run}-{merged}", whole=True)
            system.delete_dir(f"{root}/{OPEN}/part={run}-{merged}")
            held, size, merged = [], 0, merged + 1

        for row in rows:
            alert = row.asDict()
            batch = alert.pop("outbox_batch")
            if "outbox_text" in alert:
                alert = json.loads(alert["outbox_text"]) | {"alert_id": alert["alert_id"]}
            try:
                post([alert])
                sent = True
            except Exception:  # noqa: BLE001  a webhook that fails must not stop the alerts
                sent = False
            done.append((batch, json.dumps({"id": alert["alert_id"], "sent": sent, "alert": json.dumps(alert, default=str), "run": run}) + "\n"))
            if len(done) == CHUNK:
                record()
                if size >= MERGED:
                    merge()
        if done:
            record()
        if held:
            merge()

    return send


def post_once(alerts: DataFrame, batch: int, post: Post, outbox: str) -> None:
    """Posts the alerts of a micro-batch that its records do not have as sent, partitions side by side, and records them."""
    sent = states(records(alerts.sparkSession, outbox, batch)).where("sent").select(F.col("id").alias("alert_id"))
    todo = identified(alerts).join(sent, "alert_id", "left_anti").withColumn("outbox_batch", F.lit(batch))
    todo.foreachPartition(_sender(post, outbox))


def resend(spark: SparkSession, post: Post, outbox: str) -> None:
    """Posts what has failed so far again, and records it."""
    failed = states(records(spark, outbox)).where("NOT sent")
    failed.select("batch", "id", "alert").select(F.col("batch").alias("outbox_batch"), F.col("id").alias("alert_id"), F.col("alert").alias("outbox_text")).foreachPartition(_sender(post, outbox))
