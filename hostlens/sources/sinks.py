"""Sinks: HTTP batches and a dead-letter table."""

from __future__ import annotations

import gzip
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scan
from .scratch import dropped, written


def http_batches(lines: DataFrame, size: int = 100, per_task: int = 10_000) -> DataFrame:
    """JSON lines (seq, value) as JSON arrays of up to `size`: (batch, n, body).

    Lines are numbered within ranges of arrival, so no task orders them all.
    """
    part = F.floor(F.col("seq") / per_task)
    rank = F.row_number().over(Window.partitionBy("part").orderBy("seq")) - 1
    rows = lines.withColumn("part", part).withColumn("slot", F.floor(rank / size))
    bodies = rows.groupBy("part", "slot").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("all"))
    body = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["value"]), ","), F.lit("]"))
    return bodies.select((F.col("part") * per_task + F.col("slot")).cast("long").alias("batch"), "n", body.alias("body"))


def posted(body: str, url: str, token: str | None = None, headers: dict[str, str] | None = None, compress: bool = True, retries: int = 3, backoff: float = 0.1, timeout: float = 10.0, send: Callable | None = None) -> tuple[bool, int]:
    """Posts a body: whether it went through, and after how many attempts. The wait grows by `backoff` with each."""
    data = gzip.compress(body.encode()) if compress else body.encode()
    head = {"Content-Type": "application/json"} | ({"Content-Encoding": "gzip"} if compress else {}) | ({"Authorization": f"Bearer {token}"} if token else {}) | (headers or {})
    for attempt in range(1, retries + 2):
        if attempt > 1:
            time.sleep(backoff * (attempt - 1))
        try:
            if send is not None:
                send(url, data, head)
            else:
                urllib.request.urlopen(urllib.request.Request(url, data, head), timeout=timeout).close()
            return True, attempt
        except OSError:
            continue
    return False, retries + 1


def webhook(url: str, token: str | None = None, **options) -> Callable[[list[dict]], None]:
    """A function that posts each alert as a JSON object of its own, with a bearer token if given; one that fails is an OSError.

    options are those of posted(); an alert is sent once unless `retries` says otherwise.
    """
    options = {"compress": False, "retries": 0} | options

    def post(alerts: list[dict]) -> None:
        for alert in alerts:
            if not posted(json.dumps(alert, default=str), url, token, **options)[0]:
                raise OSError(f"an alert could not be posted to {url}")

    return post


def post_batches(batches: DataFrame, url: str, **options) -> DataFrame:
    """Posts each batch from the executors: (batch, sent, attempts); options are those of posted()."""

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(batch, *posted(body, url, **options)) for batch, body in zip(frame["batch"], frame["body"])], columns=["batch", "sent", "attempts"])

    return batches.mapInPandas(post, "batch long, sent boolean, attempts int")


def dead_letters(failed: DataFrame, cap_bytes: int = 256_000_000, spools: int = 1) -> DataFrame:
    """Failed batches (batch, body) that fit under a cap, in order; one that is refused takes no room.

    Each of `spools` (an agent's, say, by `batch` modulo) fills on its own, and none is one task: a round takes
    what fits by sums so far, which are a scan in segments, then drops what is larger than the room that is left, as
    it can fit no more; rounds end when nothing is left to look at. Sizes alone go through the rounds.
    """
    rows = failed.withColumn("spool", F.pmod("batch", F.lit(spools))).withColumn("bytes", F.octet_length("body").cast("long"))
    left = written(rows.select("spool", "batch", "bytes", F.lit(0).cast("long").alias("used")), "waiting")
    taken = []
    while not left.isEmpty():
        sums = written(scan.running(left, ["spool"], ["batch", "bytes"], {"so_far": scan.total(F.col("bytes"))}), "sums")
        fits = F.col("used") + F.col("so_far") <= cap_bytes
        taken.append(sums.where(fits).select("batch", (F.col("used") + F.col("so_far")).alias("used")))
        now = sums.groupBy("spool").agg(F.max(F.when(fits, F.col("used") + F.col("so_far"))).alias("now"))
        rest = sums.where(~fits).join(now, "spool").withColumn("used", F.coalesce("now", "used"))
        after = written(rest.where(F.col("bytes") <= cap_bytes - F.col("used")).select("spool", "batch", "bytes", "used"), "waiting")
        dropped(left)
        left = after
    fits = reduce(DataFrame.unionByName, taken) if taken else left.select("batch", "used")
    return rows.join(fits, "batch").select("spool", "batch", "bytes", "used", "body")
