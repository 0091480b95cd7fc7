"""Operators that depend on the order in which events arrive.

A history goes through windows: what a pid's live process is, which parent a child has, what a score has
reached. Only a cooldown walks, as each row that passes decides on the next; it walks the few rows that a
rule found, sorted by key, from one that passes to the next. Streams keep the same in typed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.rules import Rules
from ..sources.scratch import written
from . import scan


# Enrichment


class ProcessSlot:
    """The live process of a pid: a creation with a time stands above one without."""

    FIELDS = "key string, strong boolean, image string"

    def __init__(self) -> None:
        self.key: str | None = None
        self.strong = False
        self.image: str | None = None

    def take(self, row: dict) -> Iterator[tuple]:
        kind, time = row["type"], row["create_time"]
        key = f"{int(row['pid'])}:{int(time or 0)}"
        if kind == "ProcessCreate":
            if time is not None or not self.strong:
                self.key, self.strong, self.image = key, time is not None, row["image_path"] or None
            yield row["seq"], self.key, None
        elif kind == "ProcessTerminate":
            if self.key is not None and (self.key == key if time is not None else not self.strong):
                yield row["seq"], self.key, self.image
                self.key, self.strong, self.image = None, False, None
            else:
                yield row["seq"], None, None
        else:
            yield row["seq"], self.key, self.image


CONTEXTS = "seq long, context_key string, context_image string"


def slot_rows(events: DataFrame) -> DataFrame:
    d = F.col("data")
    pid = F.when(d["type"].isin("ProcessCreate", "ProcessTerminate"), d["pid"]).otherwise(C.acting_pid(d))
    return events.select("agent_id", pid.alias("pid"), "seq", d["type"].alias("type"), d["create_time"].alias("create_time"), d["image_path"].alias("image_path")).where("pid IS NOT NULL")


def enriched(events: DataFrame) -> DataFrame:
    """For each event of a process the context that its pid's live process gives it when it arrives.

    A creation gets its key (or the stronger one that stays), a termination the process that it ends,
    other acting events the live one; image_path comes with all but creations. A creation with a time is live
    until the next such one, or until a termination of its time; where none is live, the last creation without
    a time is, until a termination without one. So one window finds the last creation with a time, a second
    whether it has ended, a third the last of those without: all by (agent, pid), after one shuffle.
    """
    kind, time = F.col("type"), F.col("create_time")
    create, end = kind == "ProcessCreate", kind == "ProcessTerminate"
    image = F.nullif("image_path", F.lit(""))
    rows = slot_rows(events)
    so_far = Window.partitionBy("agent_id", "pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("strong", F.last(F.when(create & time.isNotNull(), F.struct("seq", "create_time", image.alias("image"))), ignorenulls=True).over(so_far))
    before = Window.partitionBy("agent_id", "pid", "strong.seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ends_strong = end & (time == F.col("strong.create_time"))
    rows = rows.withColumn("live", F.col("strong").isNotNull() & ~F.coalesce(F.max(ends_strong).over(before), F.lit(False)))
    made, gone = create & time.isNull(), end & (time.isNull() | (time == 0))
    change = F.when(~F.col("live") & (made | gone), F.struct(made.alias("is"), image.alias("image")))
    rows = rows.withColumn("weak", F.last(change, ignorenulls=True).over(before))
    text = lambda t: F.concat(F.col("pid").cast("long").cast("string"), F.lit(":"), F.coalesce(t, F.lit(0)).cast("long").cast("string"))
    weak = ~F.col("live") & F.coalesce(F.col("weak.is"), F.lit(False))
    held = F.when(F.col("live"), text(F.col("strong.create_time"))).when(weak, text(F.lit(0)))
    of = F.when(F.col("live"), F.col("strong.image")).when(weak, F.col("weak.image"))
    stops = F.when(F.col("live"), ends_strong).when(weak, gone)
    key = F.when(create, F.coalesce(held, text(F.lit(0)))).when(~end | stops, held)
    return rows.select("seq", key.alias("context_key"), F.when(~create & (~end | stops), of).alias("context_image"))


# Alerts


def alert_candidates(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Alerts of single events before the cooldown: detections, LOLBins and unsigned DLLs."""
    d, context = F.col("data"), F.col("process_context")
    key = F.coalesce(C.effective_key(context, d), F.lit("pid:0"))
    told = F.coalesce(context["image_path"], F.concat(F.lit("PID "), d["pid"].cast("string")))
    base = C.basename(d["image_path"])

    def of(test: Column, kind: str, rule: Column, severity: Column, mitre: Column, image: Column, detail: Column, dedup: Column) -> DataFrame:
        return events.where(test).select("agent_id", "seq", "event_ts", F.lit(kind).alias("alert_type"), rule.alias("rule"), severity.alias("severity"), mitre.alias("mitre"), key.alias("pkey"), F.coalesce(d["pid"], F.lit(0)).alias("pid"), image.alias("image"), detail.alias("detail"), F.concat_ws("|", key, dedup).alias("dedup"))

    found = of((d["type"] == "EvasionDetected") & F.col("rule").isNotNull(), "detection", F.col("rule.id"), F.col("severity"), F.col("rule.mitre.technique_id"), F.coalesce(context["image_path"], d["process_name"], F.lit("")), C.event_summary(d), F.col("rule.id"))
    tools = of((d["type"] == "ProcessCreate") & F.lower(base).isin(*rules.lolbins), "hunt", F.lit("lolbin"), F.lit("Medium"), F.lit("T1218"), d["image_path"], F.concat(F.lit("LOLBin execution: "), base, F.lit(" ("), d["command_line"], F.lit(")")), F.lit("lolbin"))
    loads = of((d["type"] == "ImageLoad") & ~d["signed"], "hunt", F.lit("unsigned-dll"), F.lit("Low"), F.lit("T1574.001"), told, F.concat(F.lit("Unsigned DLL loaded: "), d["image_name"], F.lit(" ("), d["image_path"], F.lit(")")), F.concat(F.lit("unsigned-dll|"), d["image_name"]))
    return found.unionByName(tools).unionByName(loads)


def seconds(time: Column) -> Column:
    """Seconds since 1970 of a timestamp, with their fraction."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz")) / 1e6


def passing(at: np.ndarray, last: float | None, wait: float) -> tuple[np.ndarray, float | None]:
    """Which of one key's rows pass if each waits `wait` seconds after the one that passed before, and the last that passed.

    Those before one that passes are earlier than it, so the next is found in the running maximum.
    """
    keep, most, i = np.zeros(len(at), bool), np.maximum.accumulate(at), 0
    while i < len(at):
        if last is not None:
            # Two places back, as the sum may be rounded where the difference is not.
            i = max(i, int(np.searchsorted(most, last + wait)) - 2)
            while i < len(at) and at[i] - last < wait:
                i += 1
            if i == len(at):
                break
        keep[i], last = True, float(at[i])
        i += 1
    return keep, last


def last_passes(at: np.ndarray, wait: float) -> tuple[np.ndarray, np.ndarray]:
    """How the last pass before a key's rows decides on the last pass in them: (bounds, ends), both rising.

    A last pass t leads to the end of the first bound that is `wait` or more after it, or stays where there is none;
    no pass before leads to the first end. A pass stands at a new maximum, and so does the next one after it; the
    passes that follow from each are found by doubled jumps.
    """
    most = np.maximum.accumulate(at)
    tops = at[np.append(True, at[1:] > most[:-1])]
    here = np.arange(len(tops))
    # One place back, as the sum may be rounded where the difference is not.
    following = np.maximum(np.searchsorted(tops, tops + wait) - 1, here + 1)
    while len(short := np.flatnonzero((following < len(tops)) & (tops[np.minimum(following, len(tops) - 1)] - tops < wait))):
        following[short] += 1
    jump = np.where(following < len(tops), following, here)
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    ends = tops[jump]
    last = np.append(ends[1:] != ends[:-1], True)
    return tops[last], ends[last]


_SUMMARY = "segment int, first_key string, last_key string, bounds binary, ends binary"


def _runs(batch: pa.RecordBatch) -> list[int]:
    """Where runs of one key start, and the end."""
    x = batch.column("cooled_key")
    return [0, *(np.flatnonzero(np.asarray(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)))) + 1).tolist(), len(x)]


def _fold(wait: float):
    """A segment's summary: its first and last key, and what the last key's rows do to a last pass."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, first, key, held = None, None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, at = _runs(batch), np.asarray(batch.column("cooled_at"))
            if segment is None:
                segment, first = batch.column("segment")[0].as_py(), batch.column("cooled_key")[0].as_py()
            for i, j in zip(starts, starts[1:]):
                if (now := batch.column("cooled_key")[i].as_py()) != key:
                    key, held = now, []
                held.append(at[i:j])
        if segment is not None:
            bounds, ends = last_passes(np.concatenate(held), wait)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "first_key": [first], "last_key": [key], "bounds": [bounds.tobytes()], "ends": [ends.tobytes()]})

    return of


def _carried(wait: float):
    """Summaries in order as (segment, carried): the last pass of the segment's first key before it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            rows = []
            for segment, first, now, bounds, ends in zip(*(batch.column(c).to_pylist() for c in ("segment", "first_key", "last_key", "bounds", "ends"))):
                carried = last if first == key else None
                rows.append((segment, carried))
                bounds, ends = np.frombuffer(bounds), np.frombuffer(ends)
                if carried is None or first != now:
                    last = float(ends[0])
                else:
                    later = np.flatnonzero(bounds - carried >= wait)
                    last = float(ends[later[0]]) if len(later) else carried
                key = now
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.float64())], ["segment", "carried"])

    return of


def cooled(rows: DataFrame, cooldown: float, key: list[str] | None = None, order: list[str] | None = None, time: Column | None = None) -> DataFrame:
    """Rows that stay when each key waits `cooldown` seconds after a row that passed; rows held back don't count.

    The order is by event_ts and seq, and the time event_ts, unless given. Rows are cut into segments by a range
    sort by key and order, so a key of very many rows is many segments. Each is folded to what it does to the last
    pass before it; these summaries are composed one after another, and each segment is walked from the pass
    that is carried into it.
    """
    keys, names = key or ["agent_id", "dedup"], rows.columns
    timed = rows.withColumns({"cooled_at": seconds(F.col("event_ts")) if time is None else time, "cooled_key": F.to_json(F.struct(*keys))})
    sort = ["cooled_key", *(order or ["cooled_at", "seq"])]
    placed = scan.segmented(timed, sort, "cooldown")
    count = (placed.agg(F.max("segment")).first()[0] or 0) + 1
    dealt = placed.repartitionById(count, "segment").sortWithinPartitions(*sort)
    if count > 1:
        folded = dealt.select("segment", "cooled_key", "cooled_at").mapInArrow(_fold(cooldown), _SUMMARY)
        # A shuffle of a row for each segment: coalesce(1) alone would fold them all in one task.
        carried = written(folded.repartition(1).sortWithinPartitions("segment").mapInArrow(_carried(cooldown), "segment int, carried double"), "carried")
        placed = placed.join(F.broadcast(carried), "segment", "left")  # a row for each segment
        dealt = placed.repartitionById(count, "segment").sortWithinPartitions(*sort)
    else:
        dealt = dealt.withColumn("carried", F.lit(None).cast("double"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, at, keep = _runs(batch), np.asarray(batch.column("cooled_at")), np.zeros(batch.num_rows, bool)
            for i, j in zip(starts, starts[1:]):
                mine = batch.column("cooled_key")[i].as_py() if i == 0 or j == batch.num_rows else None
                if held is None and i == 0:
                    last = batch.column("carried")[0].as_py()
                elif i or mine != held:
                    last = None
                keep[i:j], last = passing(at[i:j], last, cooldown)
            held = mine
            yield batch.filter(pa.array(keep)).select(names)

    return dealt.mapInArrow(walk, rows.schema)


ALERTS = "seq long, alert_type string, rule string, severity string, mitre string, pkey string, pid long, image string, detail string, score long, at double"


def alert_rows(events: DataFrame) -> DataFrame:
    """Events that alerts and scores are made of, flat."""
    d, context = F.col("data"), F.col("process_context")
    kind = F.when(d["type"] == "ProcessCreate", "create").when((d["type"] == "EvasionDetected") & F.col("rule").isNotNull(), "detection").when((d["type"] == "ImageLoad") & ~d["signed"], "unsigned").when(d["type"] == "NetworkConnect", "network").when(d["type"] == "DnsQuery", "dns")
    told = F.coalesce(context["image_path"], F.concat(F.lit("PID "), d["pid"].cast("string")))
    k = F.col("kind")
    image = F.when(k == "create", d["image_path"]).when(k == "detection", F.coalesce(context["image_path"], d["process_name"], F.lit(""))).otherwise(told)
    value = F.when(k == "detection", F.col("rule.id")).when(k == "unsigned", d["image_name"]).when((k == "network") & C.is_public_ip(d["dst_addr"]), d["dst_addr"]).when((k == "dns") & (d["query_name"] != ""), d["query_name"])
    detail = F.when(k == "detection", C.event_summary(d)).when(k == "unsigned", F.concat(F.lit("Unsigned DLL loaded: "), d["image_name"], F.lit(" ("), d["image_path"], F.lit(")")))
    rows = events.withColumn("kind", kind).where("kind IS NOT NULL")
    return rows.select("agent_id", "seq", seconds(F.col("event_ts")).alias("at"), "kind", F.coalesce(C.effective_key(context, d), F.lit("pid:0")).alias("pkey"), F.coalesce(d["pid"], F.lit(0)).alias("pid"), d["ppid"].alias("ppid"), image.alias("image"), value.alias("value"), d["command_line"].alias("line"), "severity", F.col("rule.mitre.technique_id").alias("mitre"), detail.alias("detail"))


def _spawned(made: DataFrame, rules: Rules) -> DataFrame:
    """Suspicious children with the parent that makes them so, each once: by (agent, ppid).

    The last process of the ppid before a child decides, if there is one; else the first suspicious parent after
    it. The place (n) is where both are known.
    """
    low = F.lower("base")
    parent = F.struct("n", "seq", "at", "base", low.isin(*rules.suspicious_parents).alias("bad"))
    child = made.where(low.isin(*rules.suspicious_children)).withColumns({"key": F.col("ppid"), "side": F.lit(0), "parent": F.lit(None).cast(made.select(parent.alias("p")).schema["p"].dataType)})
    sides = child.unionByName(made.withColumns({"key": F.col("pid"), "side": F.lit(1), "parent": parent}))
    mine = Window.partitionBy("agent_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("parent", ignorenulls=True).over(mine.orderBy("n", "side"))
    after = F.last(F.when(F.col("parent.bad"), F.col("parent")), ignorenulls=True).over(mine.orderBy(F.desc("n"), "side"))
    found = sides.withColumns({"before": before, "after": after}).where("side = 0").withColumn("p", F.coalesce("before", "after"))
    found = found.where("p.bad AND p.at <= at")
    late = F.col("before").isNull()
    return found.select("agent_id", F.greatest("n", "p.n").alias("n"), F.col("n").alias("ord"), F.when(late, F.col("p.seq")).otherwise(F.col("seq")).alias("seq"), F.when(late, F.col("p.at")).otherwise(F.col("at")).alias("tm"), F.col("at").alias("about"), "pkey", "pid", "image", F.concat(F.col("p.base"), F.lit(" spawned "), "base", F.lit(" ("), "line", F.lit(")")).alias("detail"))


def _totals(marks: DataFrame, touched: DataFrame, rules: Rules) -> DataFrame:
    """The score that each touched (agent_id, pkey, n) has reached, by a running window over (agent, process).

    What counts once (an address, a name, a flag) is reduced to its first mark before the shuffle by process.
    """
    each = F.col("kind").isin("detection", "unsigned")
    first = F.min_by(F.struct("n", "pid", "image"), "n").alias("m")
    once = marks.where(~each).groupBy("agent_id", "pkey", "kind", "value").agg(first).select("agent_id", "pkey", "kind", "m.*")
    points = {"detection": rules.detection, "unsigned": rules.unsigned_dll, "parent": rules.suspicious_parent, "lolbin": rules.lolbin, "ip": rules.external_ip, "name": rules.dns_query}
    worth = F.lit(0)
    for kind, n in points.items():
        worth = F.when(F.col("kind") == kind, F.lit(n)).otherwise(worth)
    rows = marks.where(each).select("agent_id", "pkey", "kind", "n", "pid", "image").unionByName(once)
    rows = rows.select("agent_id", "pkey", "n", F.struct("pid", "image").alias("who"), worth.alias("worth")).unionByName(touched.select("agent_id", "pkey", "n", "seq", "tm"), allowMissingColumns=True)
    so_far = Window.partitionBy("agent_id", "pkey").orderBy("n", F.col("tm").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"total": F.sum("worth").over(so_far).cast("long"), "who": F.first("who", ignorenulls=True).over(so_far)})
    return rows.where(F.col("tm").isNotNull() & F.col("who").isNotNull())


def backtest(events: DataFrame, rules: Rules = Rules(), order: str = "at") -> DataFrame:
    """Alerts of a history in time order (or with order="seq" as they arrived), cooldown in event time.

    Nothing walks an agent's events: parents are windows by (agent, pid), scores by (agent, process), and the
    cooldowns go by (agent, what they hold back). An alert has the seq of the event that raised it and the time
    that it is about, a late parent's the child's.
    """
    rows = alert_rows(events).withColumn("n", F.struct("at", "seq") if order != "seq" else F.struct("seq"))
    rows = rows.withColumns({"base": F.coalesce(C.basename(F.col("image")), F.lit("")), "line": F.coalesce("line", F.lit("")), "pid": F.col("pid").cast("long")})
    rows = written(rows, "marked")  # read by each rule
    made = rows.where("kind = 'create'").select("agent_id", "n", "seq", "at", "pkey", "pid", F.col("ppid").cast("long").alias("ppid"), "image", "base", "line")
    spawned = _spawned(made, rules)
    tool = F.lower("base").isin(*rules.lolbins)

    def raised(found: DataFrame, kind: str, rule: Column, severity: Column, mitre: Column, detail: Column, dedup: Column) -> DataFrame:
        about = {"ord": F.col("n"), "tm": F.col("at"), "about": F.col("at")} if "about" not in found.columns else {}
        return found.withColumns(about).select("agent_id", "n", "ord", "seq", "tm", "about", F.lit(kind).alias("alert_type"), rule.alias("rule"), severity.alias("severity"), mitre.alias("mitre"), "pkey", "pid", "image", detail.alias("detail"), F.concat_ws("|", "pkey", dedup).alias("dedup"))

    word = F.lit
    detail = F.col("detail")
    raw = raised(made.where(tool), "hunt", word("lolbin"), word("Medium"), word("T1218"), F.concat(F.lit("LOLBin execution: "), "base", F.lit(" ("), "line", F.lit(")")), word("lolbin"))
    raw = raw.unionByName(raised(spawned, "hunt", word("suspicious-parent"), word("High"), word("T1204.002"), detail, word("suspicious-parent")))
    raw = raw.unionByName(raised(rows.where("kind = 'detection'"), "detection", F.col("value"), F.col("severity"), F.col("mitre"), detail, F.col("value")))
    raw = raw.unionByName(raised(rows.where("kind = 'unsigned'"), "hunt", word("unsigned-dll"), word("Low"), word("T1574.001"), detail, F.concat(F.lit("unsigned-dll|"), "value")))
    first = written(cooled(raw, rules.cooldown, order=["n", "ord"], time=F.col("tm")), "alerts")

    kind = F.when(F.col("kind") == "network", "ip").when(F.col("kind") == "dns", "name").when((F.col("kind") == "create") & tool, "lolbin").otherwise(F.col("kind"))
    flag = F.col("kind").isin("create", "lolbin", "parent")
    marks = rows.where("kind NOT IN ('network', 'dns') OR value IS NOT NULL").withColumn("kind", kind).select("agent_id", "pkey", "n", "pid", "image", "kind", "value")
    marks = marks.unionByName(spawned.select("agent_id", "pkey", "n", "pid", "image", F.lit("parent").alias("kind"), F.lit(None).cast("string").alias("value")))
    marks = marks.withColumn("value", F.when(~flag, F.col("value")))
    acts = rows.where("kind IN ('network', 'dns')").select("agent_id", "pkey", "n", "seq", F.col("at").alias("tm"))
    touched = acts.unionByName(first.select("agent_id", "pkey", "n", "seq", "tm").dropDuplicates(["agent_id", "pkey", "n"]))
    high = _totals(marks, touched, rules).where(F.col("total") >= rules.threshold)
    high = cooled(high.select("agent_id", "n", "seq", "tm", "pkey", "who", "total"), rules.cooldown, ["agent_id", "pkey"], ["n"], F.col("tm"))
    scored = high.select("seq", F.lit("score").alias("alert_type"), F.lit("score-threshold").alias("rule"), F.lit("High").alias("severity"), F.lit(None).cast("string").alias("mitre"), "pkey", "who.pid", "who.image", F.concat(F.lit("Process score "), "total", F.lit(f" reached threshold {rules.threshold}")).alias("detail"), F.col("total").alias("score"), F.col("tm").alias("at"))
    return first.select("seq", "alert_type", "rule", "severity", "mitre", "pkey", "pid", "image", "detail", F.lit(None).cast("long").alias("score"), F.col("about").alias("at")).unionByName(scored)
