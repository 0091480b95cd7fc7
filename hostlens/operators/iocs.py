"""Indicators of compromise: addresses, domains and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def sightings(events: DataFrame) -> DataFrame:
    """Rows (kind, value, source, event_ts) of every indicator that an event holds, in one pass over the events."""
    d = F.col("data")
    named = (d["type"] == "DnsQuery") & (d["query_name"] != "")

    def of(kind: str, test, values, source) -> object:
        each = F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"), source.alias("source")))
        return F.coalesce(F.when(test, each), F.array().cast("array<struct<kind:string,value:string,source:string>>"))

    base = C.basename(d["image_path"])
    public = F.filter(C.response_addresses(d["response"]), C.is_public_ip)
    found = F.concat(
        of("ip", (d["type"] == "NetworkConnect") & C.is_public_ip(d["dst_addr"]), F.array(d["dst_addr"]), base),
        of("ip", named & d["response"].isNotNull(), public, F.concat(F.lit("DNS/"), d["query_name"])),
        of("domain", named, F.array(d["query_name"]), F.lit("DnsQuery")),
        of("hash", (d["type"] == "ProcessCreate") & d["hashes"].isNotNull(), C.hash_list(d["hashes"]), base),
        of("hash", (d["type"] == "ImageLoad") & d["hashes"].isNotNull(), C.hash_list(d["hashes"]), d["image_name"]),
    )
    return events.where(d["type"].isin("NetworkConnect", "DnsQuery", "ProcessCreate", "ImageLoad")).select(F.explode(found).alias("i"), "event_ts").select("i.*", "event_ts")


def indicators(events: DataFrame, kind: str | None = None) -> DataFrame:
    """Each indicator with its count, first time and distinct sources (sorted, joined by a comma)."""
    if kind not in (None, "ip", "domain", "hash"):
        raise ValueError(f"unknown kind of indicator: {kind}")
    rows = sightings(events)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    # Sources are made distinct by a grouping first, so that no group gathers more than its distinct sources.
    each = rows.groupBy("kind", "value", "source").agg(F.count("*").alias("n"), F.min("event_ts").alias("first_seen"))
    return each.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


def top_indicators(events: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """The most frequent indicators of each kind."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    return indicators(events, kind).withColumn("rank", rank).where(F.col("rank") <= limit)
