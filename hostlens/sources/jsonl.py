"""Event files: JSON lines in, as a batch or a stream, and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import columns as C
from ..schema import LINE, SOURCE_WORDS, is_event
from . import follow
from .lines_sink import RotatedLines


def parsed(lines: DataFrame, raw: str = "value") -> DataFrame:
    """Events of lines of text: blank and malformed lines are left out, other columns stay.

    Adds event_ts, source_type, source_detail and severity_ord, and keeps the line as raw. The parsed line
    comes out of a generator of one row, past which the optimiser copies no expression, so that each line is
    parsed once and not once a field.
    """
    rest = [c for c in lines.columns if c != raw]
    rows = lines.select(*rest, F.col(raw).alias("raw"), F.explode(F.array(F.from_json(raw, LINE))).alias("e")).where(is_event(F.col("e")))
    rows = rows.select("e.*", "raw", *rest)
    return rows.withColumns({
        "id": F.lower("id"),
        "event_ts": F.try_to_timestamp("timestamp"),
        "source_type": C.source_type(F.col("source")),
        "source_detail": C.source_detail(F.col("source")),
        "severity_ord": C.severity_ord(F.col("severity")),
    })


def arrival() -> Column:
    """What orders lines as they stand in files: path, then place in the file's scan."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A batch of event files, with the arrival order as seq (a struct). A missing path is an error."""
    return parsed(spark.read.text(path).select("value", arrival().alias("seq")))


def stream_events(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """A stream of closed event files; with `since` only of files modified after it."""
    lines = spark.readStream.text(path)
    if since is not None:
        lines = lines.where(F.col("_metadata.file_modification_time") > F.lit(since).cast("timestamp"))
    return parsed(lines)


def follow_events(spark: SparkSession, path: str, since: str = "start", max_bytes: int = 0, ledger: str | None = None) -> DataFrame:
    """A stream of the events appended to a folder's files, through rotations; with since="end" only of what comes from now on.

    max_bytes bounds a micro-batch, ledger is where a bounded stream keeps its place (see follow.AppendedLines).
    """
    return parsed(follow.appended(spark, path, since, max_bytes, ledger))


def as_lines(events: DataFrame, pretty: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """Events as JSON lines in the form that read_events takes, with the columns `also`."""
    names = ["id", "timestamp", "hostname", "agent_id", "sensor_version", "source", "category", "severity", "data", "rule", "process_context"]
    options = {"pretty": "true"} if pretty else {}
    word = F.col("source").isin(*SOURCE_WORDS)
    mark = F.concat(F.lit("@"), F.col("source"), F.lit("@"))
    text = F.to_json(F.struct(*[mark.alias("source") if n == "source" else F.col(n) for n in names]), options)
    # An object stands as it is, a word in quotes.
    whole = F.replace(text, F.concat(F.lit('"'), F.replace(F.replace(mark, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.when(word, F.concat(F.lit('"'), F.col("source"), F.lit('"'))).otherwise(F.col("source")))
    return events.select(whole.alias("value"), *also)


def write_lines(events: DataFrame, path: str, rotation_bytes: int = 100_000_000) -> None:
    """Appends events as JSON lines to a folder, in files of under rotation_bytes (0: no limit) that show all at once."""
    events.sparkSession.dataSource.register(RotatedLines)
    as_lines(events).write.format("rotated_lines").option("rotation_bytes", rotation_bytes).mode("append").save(path)


def stream_lines(events: DataFrame, path: str, checkpoint: str, rotation_bytes: int = 100_000_000, writer: str = "stream") -> DataStreamWriter:
    """The same for a stream: each micro-batch shows once, also when it is run again. The caller starts it."""
    events.sparkSession.dataSource.register(RotatedLines)
    out = as_lines(events).writeStream.format("rotated_lines").option("path", path).option("rotation_bytes", rotation_bytes)
    return out.option("writer", writer).option("checkpointLocation", checkpoint)
