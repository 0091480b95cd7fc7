"""Hunting rules over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.rules import Rules
from . import scan

RULES = ("suspicious-parent", "lolbin", "unsigned-dll", "beaconing")
_D = F.col


def _finding(rule: str, severity: str, mitre: str, pid, key, image, detail) -> list:
    return ["seq", "event_ts", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(mitre).alias("mitre"), pid.alias("pid"), key.alias("pkey"), image.alias("image"), detail.alias("detail")]


def creations(events: DataFrame) -> DataFrame:
    """Process creations, flat: agent, pid, ppid, key, image and command line."""
    d = F.col("data")
    return events.where(d["type"] == "ProcessCreate").select("agent_id", "seq", "event_ts", d["pid"].alias("pid"), d["ppid"].alias("ppid"), C.effective_key(F.col("process_context"), d).alias("pkey"), d["image_path"].alias("image_path"), d["command_line"].alias("command_line"))


def with_parent(created: DataFrame) -> DataFrame:
    """Creations with parent_image, that of the latest earlier creation of their ppid on the same agent.

    Children and parents are one table with a side each, ordered by time; the last parent so far of an
    (agent, pid) is a scan in segments, so there is no join on a range and a pid of any number of rows is
    spread. A child stands before a parent of the same row, so no process is its own parent.
    """
    child = created.withColumns({"key": F.col("ppid"), "side": F.lit(0), "parent": F.lit(None).cast("string")})
    parent = created.withColumns({"key": F.col("pid"), "side": F.lit(1), "parent": F.col("image_path")})
    out = scan.running(child.unionByName(parent), ["agent_id", "key"], ["event_ts", "seq", "side"], {"parent_image": scan.last(F.col("parent"))})
    return out.where("side = 0").drop("key", "side", "parent")


def suspicious(parent_image, image, rules: Rules):
    low = lambda x: F.lower(C.basename(x))
    return low(parent_image).isin(*rules.suspicious_parents) & low(image).isin(*rules.suspicious_children)


def suspicious_parent(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    rows = with_parent(creations(events)).where(suspicious(F.col("parent_image"), F.col("image_path"), rules))
    detail = F.concat(C.basename(F.col("parent_image")), F.lit(" spawned "), C.basename(F.col("image_path")), F.lit(" ("), F.col("command_line"), F.lit(")"))
    return rows.select(*_finding("suspicious-parent", "High", "T1204.002", F.col("pid"), F.col("pkey"), F.col("image_path"), detail))


def lolbin(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    base = C.basename(F.col("image_path"))
    detail = F.concat(F.lit("LOLBin execution: "), base, F.lit(" ("), F.col("command_line"), F.lit(")"))
    return creations(events).where(F.lower(base).isin(*rules.lolbins)).select(*_finding("lolbin", "Medium", "T1218", F.col("pid"), F.col("pkey"), F.col("image_path"), detail))


def unsigned_dll(events: DataFrame) -> DataFrame:
    d = F.col("data")
    image = F.coalesce(F.col("process_context.image_path"), F.concat(F.lit("PID "), d["pid"].cast("string")))
    detail = F.concat(F.lit("Unsigned DLL loaded: "), d["image_name"], F.lit(" ("), d["image_path"], F.lit(")"))
    return events.where((d["type"] == "ImageLoad") & ~d["signed"]).select(*_finding("unsigned-dll", "Low", "T1574.001", d["pid"], C.effective_key(F.col("process_context"), d), image, detail))


def beaconing(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Processes with many connections to one public address; time, pid and image are the first's."""
    d = F.col("data")
    rows = events.where((d["type"] == "NetworkConnect") & C.is_public_ip(d["dst_addr"])).select("seq", "event_ts", d["dst_addr"].alias("dst"), C.effective_key(F.col("process_context"), d).alias("pkey"), d["pid"].alias("pid"), d["image_path"].alias("image"))
    rows = rows.groupBy("dst", "pkey").agg(F.count("*").alias("n"), F.min("event_ts").alias("event_ts"), F.min("seq").alias("seq"), F.min_by("pid", "seq").alias("pid"), F.min_by("image", "seq").alias("image"))
    detail = F.concat(F.col("n").cast("string"), F.lit(" connections to "), F.col("dst"), F.lit(" from "), C.basename(F.col("image")))
    return rows.where(F.col("n") >= rules.beaconing_threshold).select(*_finding("beaconing", "Medium", "T1071.001", F.col("pid"), F.col("pkey"), F.col("image"), detail))


def hunt(events: DataFrame, rules: Rules = Rules(), only: tuple[str, ...] = RULES, limit: int = 50) -> DataFrame:
    """Findings of the enabled rules, the gravest and then the earliest first."""
    made = {"suspicious-parent": lambda: suspicious_parent(events, rules), "lolbin": lambda: lolbin(events, rules), "unsigned-dll": lambda: unsigned_dll(events), "beaconing": lambda: beaconing(events, rules)}
    if unknown := set(only) - set(made):
        raise ValueError(f"unknown rule: {sorted(unknown)[0]}")
    parts = [made[r]() for r in RULES if r in only]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(F.desc(C.severity_ord(F.col("severity"))), "event_ts", "rule", "seq").limit(limit)
