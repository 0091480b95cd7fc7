"""Alerts of a stream: three stateful steps in a row, each with typed state of its own and a fine key.

Families, by (agent, pid), find suspicious children: the pid's process and the children that wait for it.
Cooldowns, by (agent, what is held back), keep the time of the last alert that passed. Scores, by (agent,
process), count what a process has done, its addresses and names in maps. What one event decides by
itself is a projection before them. Keys are entries of maps, BUCKETS of which go to a step one at a time,
so a step is called for a bucket's rows and not for each of very many keys. A micro-batch reads and writes
the entries that its events touch, however many there are.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from itertools import groupby
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import columns as C
from ..operators import arrival
from ..sources.rules import Rules

_SPAWNED = "seq long, ord int, at double, about double, pkey string, pid long, image string, detail string"
_ALERT = "pkey string, seq long, ord int, at double, about double, alert_type string, rule string, severity string, mitre string, pid long, image string, detail string, spawned boolean, passed boolean"
#: Groups that the keys of a step are dealt to by their hash; state holds it, so it stays as it is.
BUCKETS = 1024
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _sorted(frames: Iterator[pd.DataFrame], order: list[str]) -> list[tuple]:
    """The rows of a bucket in a micro-batch as named tuples in order, nulls first, with None for nulls."""
    rows = []
    for frame in frames:
        columns = [[None if v != v else v for v in c.tolist()] if c.dtype.kind == "f" else c.tolist() for _, c in frame.items()]
        rows += map(namedtuple("Row", frame.columns)._make, zip(*columns))
    of = attrgetter(*order)
    return sorted(rows, key=lambda r: [x for v in of(r) for x in (v is not None, v)])


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_names(schema))
    return out.astype({n: "Int64" for n, t in (x.split() for x in schema.split(", ")) if t in ("long", "bigint", "int")})


class Families(StatefulProcessor):
    """The process of a pid and the suspicious children that came before it; gives a row for each child of a suspicious parent.

    A child is judged by the process that its ppid has when it arrives. Where there is none it waits for the
    first suspicious one, and counts unless it began before that. Those that wait are numbered.
    """

    def __init__(self, key: str, schema: str, ttl_seconds: int) -> None:
        self.key, self.schema, self.ttl = key, schema, ttl_seconds * 1000 or None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.process = handle.getMapState("process", self.key, "at double, base string, bad boolean", ttlDurationMs=self.ttl)
        self.number = handle.getMapState("number", self.key, "n long", ttlDurationMs=self.ttl)
        self.waiting = handle.getMapState("waiting", f"{self.key}, n long", "at double, pkey string, pid long, image string, base string, line string", ttlDurationMs=self.ttl)

    def _released(self, key: tuple) -> list[tuple]:
        """The children that wait for a pid, which wait no more."""
        held = []
        for n in range((self.number.getValue(key) or (0,))[0]):
            if (child := self.waiting.getValue((*key, n))) is not None:
                held.append(child)
                self.waiting.removeKey((*key, n))
        if held:
            self.number.removeKey(key)
        return held

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for pid, mine in groupby(_sorted(rows, ["agent_id", "key", "seq", "side"]), attrgetter("agent_id", "key")):
            self._take(pid, mine, out)
        yield _frame(out, self.schema)

    def _take(self, key: tuple, rows: Iterator[tuple], out: list[tuple]) -> None:
        now = before = self.process.getValue(key)
        late, first = [], len(out)

        def spawned(seq: int, at: float, parent: str, child: tuple) -> None:
            begun, pkey, pid, image, base, line = child
            out.append((key[0], seq, len(out) - first + 1, at, begun, pkey, pid, image, f"{parent} spawned {base} ({line})"))

        for r in rows:
            if r.side == 0:
                child = (r.at, r.pkey, r.pid, r.image, r.base, r.line)
                if now is None:
                    late.append(child)
                elif now[2] and now[0] <= r.at:
                    spawned(r.seq, r.at, now[1], child)
                continue
            if r.bad:
                for child in [*self._released(key), *late]:
                    if child[0] >= r.at:
                        spawned(r.seq, r.at, r.base, child)
                late = []
            now = (r.at, r.base, r.bad)
        if late:
            n = (self.number.getValue(key) or (0,))[0]
            for i, child in enumerate(late, n):
                self.waiting.updateValue((*key, i), child)
            self.number.updateValue(key, (n + len(late),))
        if now is not before:
            self.process.updateValue(key, now)

    def close(self) -> None:
        pass


class Cooldowns(StatefulProcessor):
    """The last alert that passed, of what is held back; gives the alerts with `passed`, those held back only where they spawned."""

    def __init__(self, key: str, wait: float, schema: str, ttl_seconds: int) -> None:
        self.key, self.wait, self.schema, self.ttl = key, wait, schema, ttl_seconds * 1000 or None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", self.key, "at double", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, of = [], attrgetter(*[n for n in _names(self.schema) if n != "passed"])
        for held, mine in groupby(_sorted(rows, ["agent_id", "dedup", "seq", "ord"]), attrgetter("agent_id", "dedup")):
            mine = list(mine)
            last = (self.last.getValue(held) or (None,))[0]
            passed, now = arrival.passing(np.array([r.at for r in mine], float), last, self.wait)
            if now != last:
                self.last.updateValue(held, (now,))
            out += [(*of(r), p) for r, p in zip(mine, passed.tolist()) if p or r.spawned]
        yield _frame(out, self.schema)

    def close(self) -> None:
        pass


class Scores(StatefulProcessor):
    """What a process has done so far; gives its alerts as they are, and one of its score when that is at the threshold.

    Flags and counts are one value, addresses and names are maps of which only what is new is written.
    """

    FIELDS = "pid long, image string, detections long, unsigned long, lolbin boolean, parent boolean, network long, dns long, last double"

    def __init__(self, key: str, rules: Rules, ttl_seconds: int) -> None:
        self.key, self.rules, self.ttl = key, rules, ttl_seconds * 1000 or None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("score", self.key, self.FIELDS, ttlDurationMs=self.ttl)
        self.maps = {kind: handle.getMapState(kind, f"{self.key}, value string", "seen boolean", ttlDurationMs=self.ttl) for kind in ("network", "dns")}

    def _total(self, s: dict) -> int:
        r = self.rules
        return s["detections"] * r.detection + s["parent"] * r.suspicious_parent + s["lolbin"] * r.lolbin + s["unsigned"] * r.unsigned_dll + s["network"] * r.external_ip + s["dns"] * r.dns_query

    def _mark(self, key: tuple, s: dict, kind: str, value: str | None, seen: set, fresh: bool) -> None:
        if kind in ("detection", "unsigned"):
            s["detections" if kind == "detection" else kind] += 1
        elif kind in ("lolbin", "parent"):
            s[kind] = True
        elif kind in self.maps and (kind, value) not in seen:
            seen.add((kind, value))
            # A process without a score has no addresses or names, unless these may end at other times.
            if fresh and not self.ttl or not self.maps[kind].containsKey((*key, value)):
                self.maps[kind].updateValue((*key, value), (True,))
                s[kind] += 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for process, mine in groupby(_sorted(rows, ["agent_id", "pkey", "seq", "side", "ord"]), attrgetter("agent_id", "pkey")):
            self._take(process, mine, out)
        yield _frame(out, arrival.ALERTS)

    def _take(self, key: tuple, rows: Iterator[tuple], out: list[tuple]) -> None:
        names, seen = _names(self.FIELDS), set()
        before = self.state.getValue(key)
        s = dict(zip(names, before)) if before else None
        for _, event in groupby(rows, lambda r: r.seq):
            touched = False
            for r in event:
                if r.side == 1:
                    touched |= bool(r.passed)
                    if r.passed:
                        out.append((r.seq, r.alert_type, r.rule, r.severity, r.mitre, key[1], r.pid, r.image, r.detail, None, r.about))
                touched |= r.kind in self.maps
                if r.kind is None or r.kind in self.maps and r.value is None:
                    continue
                if s is None:
                    s = dict(zip(names, (r.pid, r.image, 0, 0, False, False, 0, 0, None)))
                self._mark(key, s, r.kind, r.value, seen, before is None)
            if s is not None and touched and (total := self._total(s)) >= self.rules.threshold and (s["last"] is None or r.at - s["last"] >= self.rules.cooldown):
                s["last"] = r.at
                out.append((r.seq, "score", "score-threshold", "High", None, key[1], s["pid"], s["image"], f"Process score {total} reached threshold {self.rules.threshold}", total, r.at))
        if s is not None and (after := tuple(s[n] for n in names)) != before:
            self.state.updateValue(key, after)

    def close(self) -> None:
        pass


def _step(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, ttl: int) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl else "None")


def stream_alerts(events: DataFrame, rules: Rules = Rules(), ttl_seconds: int = 0) -> DataFrame:
    """Alerts of a stream's events in arrival order; state that no event touches goes after ttl_seconds (0: stays)."""
    k, low = F.col("kind"), F.lower("base")
    agent = f"agent_id {events.schema['agent_id'].dataType.simpleString()}, "
    rows = arrival.alert_rows(events).withColumns({"base": F.coalesce(C.basename(F.col("image")), F.lit("")), "line": F.coalesce("line", F.lit("")), "pid": F.col("pid").cast("long")})
    tool = (k == "create") & low.isin(*rules.lolbins)

    rest = [F.col(c) for c in ("seq", "at", "pkey", "pid", "image", "base", "line")]
    bad = low.isin(*rules.suspicious_parents)
    child = F.struct(F.col("ppid").cast("long").alias("key"), F.lit(0).alias("side"), bad.alias("bad"), *rest)
    process = F.struct(F.col("pid").alias("key"), F.lit(1).alias("side"), bad.alias("bad"), *rest)
    sides = rows.where(k == "create").select("agent_id", F.explode(F.array_compact(F.array(F.when(low.isin(*rules.suspicious_children) & F.col("ppid").isNotNull(), child), process))).alias("x")).select("agent_id", "x.*")
    spawned = _step(sides, ["agent_id", "key"], Families(agent + "key long", agent + _SPAWNED, ttl_seconds), agent + _SPAWNED, ttl_seconds)

    def alert(kind: Column, rule: Column, severity: Column, mitre: Column, detail: Column, dedup: Column, **more: Column) -> list[Column]:
        named = {"alert_type": kind, "rule": rule, "severity": severity, "mitre": mitre, "detail": detail, "dedup": F.concat_ws("|", "pkey", dedup)} | more
        return ["agent_id", "seq", "at", "pkey", "pid", "image", *[c.alias(n) for n, c in named.items()]]

    def by_kind(detection: Column, lolbin: Column, unsigned: Column) -> Column:
        return F.when(k == "detection", detection).when(k == "create", lolbin).otherwise(unsigned)

    word = F.lit
    raised = rows.where(tool | k.isin("detection", "unsigned")).select(alert(
        by_kind(word("detection"), word("hunt"), word("hunt")), by_kind(F.col("value"), word("lolbin"), word("unsigned-dll")), by_kind(F.col("severity"), word("Medium"), word("Low")), by_kind(F.col("mitre"), word("T1218"), word("T1574.001")),
        by_kind(F.col("detail"), F.concat(word("LOLBin execution: "), "base", word(" ("), "line", word(")")), F.col("detail")), by_kind(F.col("value"), word("lolbin"), F.concat(word("unsigned-dll|"), "value")),
        ord=word(0), about=F.col("at"), spawned=word(False),
    ))
    born = spawned.select(alert(word("hunt"), word("suspicious-parent"), word("High"), word("T1204.002"), F.col("detail"), word("suspicious-parent"), ord=F.col("ord"), about=F.col("about"), spawned=word(True)))
    cooled = _step(raised.unionByName(born), ["agent_id", "dedup"], Cooldowns(agent + "dedup string", rules.cooldown, agent + _ALERT, ttl_seconds), agent + _ALERT, ttl_seconds)

    marks = rows.select("agent_id", "pkey", "seq", "at", word(0).alias("side"), word(0).alias("ord"), F.when(tool, "lolbin").otherwise(k).alias("kind"), "value", "pid", "image")
    alerts = cooled.withColumns({"side": word(1), "kind": F.when(F.col("spawned"), "parent"), "value": word(None).cast("string")}).drop("spawned")
    return _step(marks.unionByName(alerts, allowMissingColumns=True), ["agent_id", "pkey"], Scores(agent + "pkey string", rules, ttl_seconds), arrival.ALERTS, ttl_seconds)
