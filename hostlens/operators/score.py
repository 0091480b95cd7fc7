"""Threat scores of processes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.rules import Rules
from .hunt import creations, suspicious, with_parent


def signals(events: DataFrame) -> DataFrame:
    """Events that count for a score: (pkey, seq, pid, image, kind, value)."""
    d, context = F.col("data"), F.col("process_context")
    told = F.coalesce(context["image_path"], F.concat(F.lit("PID "), d["pid"].cast("string")))
    kind = F.when(d["type"] == "ProcessCreate", "create").when((d["type"] == "EvasionDetected") & F.col("rule").isNotNull(), "detection").when((d["type"] == "ImageLoad") & ~d["signed"], "unsigned").when((d["type"] == "NetworkConnect") & C.is_public_ip(d["dst_addr"]), "ip").when((d["type"] == "DnsQuery") & (d["query_name"] != ""), "dns")
    image = F.when(F.col("kind") == "create", d["image_path"]).when(F.col("kind") == "detection", F.coalesce(context["image_path"], d["process_name"], F.lit(""))).otherwise(told)
    value = F.when(F.col("kind") == "ip", d["dst_addr"]).when(F.col("kind") == "dns", d["query_name"]).when(F.col("kind") == "create", F.lower(C.basename(d["image_path"])))
    rows = events.withColumn("kind", kind).where("kind IS NOT NULL")
    return rows.select("agent_id", F.coalesce(C.effective_key(context, d), F.lit("pid:0")).alias("pkey"), "seq", F.coalesce(d["pid"], F.lit(0)).alias("pid"), image.alias("image"), "kind", value.alias("value"))


def breakdown(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Signals of each process: detections, lolbin, unsigned_dlls, external_ips, dns_queries, suspicious_parent."""
    rows = signals(events)
    kind = lambda k: F.col("kind") == k
    out = rows.groupBy("pkey").agg(
        F.min_by("pid", "seq").alias("pid"), F.min_by("image", "seq").alias("image"),
        F.count_if(kind("detection")).alias("detections"), F.coalesce(F.max(kind("create") & F.col("value").isin(*rules.lolbins)), F.lit(False)).alias("lolbin"),
        F.count_if(kind("unsigned")).alias("unsigned_dlls"), F.count_distinct(F.when(kind("ip"), F.col("value"))).alias("external_ips"), F.count_distinct(F.when(kind("dns"), F.col("value"))).alias("dns_queries"),
    )
    bad = with_parent(creations(events)).where(suspicious(F.col("parent_image"), F.col("image_path"), rules)).select("pkey").distinct().withColumn("suspicious_parent", F.lit(True))
    return out.join(bad, "pkey", "left").withColumn("suspicious_parent", F.coalesce("suspicious_parent", F.lit(False)))


def scores(events: DataFrame, rules: Rules = Rules(), limit: int = 20) -> DataFrame:
    """Processes with a score above 0, the highest first."""
    c = F.col
    total = c("detections") * rules.detection + c("suspicious_parent").cast("int") * rules.suspicious_parent + c("lolbin").cast("int") * rules.lolbin + c("unsigned_dlls") * rules.unsigned_dll + c("external_ips") * rules.external_ip + c("dns_queries") * rules.dns_query
    return breakdown(events, rules).select("pkey", "pid", "image", total.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "pkey").limit(limit)
