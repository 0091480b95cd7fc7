"""Registered queries over the driver's tables, and the SQL that they are held against.

Each query applies an operator to the whole telemetry that the table `events` gives (see
sources.telemetry), or to records that Spark derives from it. SQL is written on its own, not generated
from the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import arrival, explain, filters, hunt, iocs, pe, replay, score, stats, tree
from ..sources import executables, index, jsonl, normalise, sinks
from ..sources.rules import Rules
from ..sources.scratch import shared_path, written
from ..sources.telemetry import VIEW, flat, telemetry
from ..streaming import jobs, outbox
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = Rules(beaconing_threshold=3)
PUBLIC = "(dst_addr LIKE '93.184.%')"
PKEY = "coalesce(process_key, 'pid:' || CAST(pid AS VARCHAR))"
BASE = "regexp_extract(image_path, '[^/\\\\]*$', 0)"
_LOLBINS = "('certutil.exe', 'mshta.exe')"


def _query(sql: str | None = None, more: str = "") -> Callable[[Query], Query]:
    """Registers a query; `sql` selects from the flat view v, `more` are further tables of its WITH."""

    def of(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = VIEW.replace("WITH b", "WITH RECURSIVE b", 1) + (f", {more}" if more else "") + sql
        return f

    return of


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _sql_time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {column}"


# Scalar functions


@_query("SELECT seq, pid AS p FROM v")
def event_pid(spark, sf_dir):
    return telemetry(spark, sf_dir).select("seq", C.event_pid(F.col("data")).alias("p"))


@_query("SELECT seq, CASE WHEN type NOT IN ('ProcessCreate', 'ProcessTerminate') THEN pid END AS p FROM v")
def acting_pid(spark, sf_dir):
    return telemetry(spark, sf_dir).select("seq", C.acting_pid(F.col("data")).alias("p"))


@_query(f"SELECT seq, {PKEY} AS pkey FROM v")
def effective_key(spark, sf_dir):
    return telemetry(spark, sf_dir).select("seq", C.effective_key(F.col("process_context"), F.col("data")).alias("pkey"))


@_query("SELECT seq, CASE source_type WHEN 'etw' THEN 'ETW/' || source_detail WHEN 'sysmon' THEN 'Sysmon/' || source_detail WHEN 'evasion' THEN 'EvasionDetector' ELSE 'Sensor' END AS label FROM v")
def source_label(spark, sf_dir):
    """From the raw form of a source, an object or a word."""
    raw = F.when(F.col("source_type") == "etw", F.concat(F.lit('{"Etw":{"provider":"'), "source_detail", F.lit('"}}'))).when(F.col("source_type") == "sysmon", F.concat(F.lit('{"Sysmon":{"event_id":'), "source_detail", F.lit("}}"))).when(F.col("source_type") == "evasion", "EvasionDetector").otherwise("Sensor")
    return flat(spark, sf_dir).select("seq", C.source_label(C.source_type(raw), C.source_detail(raw)).alias("label"))


@_query("SELECT seq, severity_ord AS ord FROM v")
def severity_ord(spark, sf_dir):
    return telemetry(spark, sf_dir).select("seq", C.severity_ord(F.col("severity")).alias("ord"))


@_query(f"SELECT seq, {BASE} AS base, split_part(replace('a/b' || CAST(k AS VARCHAR) || '\\c' || CAST(pid AS VARCHAR), '\\', '/'), '/', 3) AS mixed FROM v WHERE image_path IS NOT NULL")
def basename(spark, sf_dir):
    rows = flat(spark, sf_dir).where("image_path IS NOT NULL")
    return rows.select("seq", C.basename(F.col("image_path")).alias("base"), C.basename(F.concat(F.lit("a/b"), "k", F.lit("\\c"), "pid")).alias("mixed"))


@_query("SELECT doc_id, head FROM (SELECT doc_id, max_by(left(text, n), n) AS head FROM (SELECT doc_id, text, unnest(range(0, 61)) AS n FROM documents WHERE text IS NOT NULL) WHERE strlen(left(text, n)) <= 60 GROUP BY doc_id)")
def truncate_bytes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    return docs.select("doc_id", C.truncate_bytes(F.col("text"), 60).alias("head"))


@_query("""SELECT seq, CASE type
  WHEN 'ProcessCreate' THEN 'ProcessCreate     pid:' || CAST(pid AS VARCHAR) || ' ' || image_path || ' ' || left(command_line, 80)
  WHEN 'ProcessTerminate' THEN 'ProcessTerminate  pid:' || CAST(pid AS VARCHAR) || ' ' || image_path
  WHEN 'NetworkConnect' THEN 'NetworkConnect    pid:' || CAST(pid AS VARCHAR) || ' TCP -> ' || dst_addr || ':' || CAST(dst_port AS VARCHAR)
  WHEN 'ImageLoad' THEN 'ImageLoad         pid:' || CAST(pid AS VARCHAR) || ' ' || image_name || CASE WHEN signed THEN ' (signed)' ELSE ' (unsigned)' END
  WHEN 'DnsQuery' THEN 'DnsQuery          pid:' || CAST(pid AS VARCHAR) || ' ' || query_name || ' (A)'
  WHEN 'ScriptBlock' THEN 'ScriptBlock       pid:' || CAST(pid AS VARCHAR) || ' PowerShell'
  WHEN 'AmsiScan' THEN 'AmsiScan          pid:' || CAST(pid AS VARCHAR) || ' PowerShell [unknown] c'
  ELSE 'EvasionDetected   pid:' || CAST(pid AS VARCHAR) || ' ' || technique || ' patched' END AS summary FROM v""")
def event_summary(spark, sf_dir):
    return telemetry(spark, sf_dir).select("seq", C.event_summary(F.col("data")).alias("summary"))


@_query("SELECT seq, CAST(pid AS VARCHAR) || ':' || CAST(coalesce(create_time, 0) AS VARCHAR) AS made FROM v WHERE type IN ('ProcessCreate', 'ProcessTerminate')")
def process_key(spark, sf_dir):
    rows = telemetry(spark, sf_dir).where(F.col("data.type").isin("ProcessCreate", "ProcessTerminate"))
    return rows.select("seq", C.process_key(F.col("data.pid"), F.col("data.create_time")).alias("made"))


_ADDRESS = "CAST(CASE k % 9 WHEN 0 THEN 10 WHEN 1 THEN 127 WHEN 2 THEN 172 WHEN 3 THEN 192 WHEN 4 THEN 169 WHEN 5 THEN 198 WHEN 6 THEN 203 WHEN 7 THEN k * 3 ELSE 224 END AS INT)"
_SECOND = "CAST(CASE k % 9 WHEN 3 THEN CASE WHEN pid % 2 = 0 THEN 168 ELSE 0 END WHEN 4 THEN 254 WHEN 5 THEN 51 WHEN 6 THEN 0 ELSE pid % 40 END AS INT)"
_THIRD = "CAST(CASE k % 9 WHEN 3 THEN 2 WHEN 5 THEN 100 WHEN 6 THEN 113 ELSE seq % 300 END AS INT)"


@_query(
    """SELECT seq, a || '.' || b || '.' || c || '.7' AS address,
  a <= 255 AND c <= 255 AND NOT (a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254)
    OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS public FROM n""",
    f"n AS (SELECT seq, {_ADDRESS} AS a, {_SECOND} AS b, {_THIRD} AS c FROM v)",
)
def is_public_ip(spark, sf_dir):
    rows = flat(spark, sf_dir).select("seq", F.concat_ws(".", F.expr(_ADDRESS), F.expr(_SECOND), F.expr(_THIRD), F.lit("7")).alias("address"))
    return rows.withColumn("public", C.is_public_ip(F.col("address")))


@_query("SELECT seq, CASE WHEN k * 400 = 0 THEN 'AMSI_RESULT_CLEAN' WHEN k * 400 < 16384 THEN 'AMSI_RESULT_NOT_DETECTED' WHEN k * 400 <= 20479 THEN 'AMSI_RESULT_BLOCKED_BY_ADMIN' WHEN k * 400 < 32768 THEN 'AMSI_RESULT_NOT_DETECTED' ELSE 'AMSI_RESULT_DETECTED' END AS result FROM v")
def amsi_result(spark, sf_dir):
    return flat(spark, sf_dir).select("seq", C.amsi_result(F.col("k") * 400).alias("result"))


@_query("SELECT seq, CASE k WHEN 1 THEN 'A' WHEN 2 THEN 'NS' WHEN 5 THEN 'CNAME' WHEN 6 THEN 'SOA' WHEN 12 THEN 'PTR' WHEN 15 THEN 'MX' WHEN 16 THEN 'TXT' WHEN 28 THEN 'AAAA' WHEN 33 THEN 'SRV' ELSE 'TYPE' || CAST(k AS VARCHAR) END AS qtype FROM v")
def dns_qtype(spark, sf_dir):
    return flat(spark, sf_dir).select("seq", C.dns_type(F.col("k")).alias("qtype"))


_DECLARED = "CASE k % 5 WHEN 0 THEN 'ab' WHEN 1 THEN '' WHEN 2 THEN chr(1) || chr(2) || ' ' || chr(9) ELSE 'C:/d' || CAST(k AS STRING) END"
_OTHER = "CASE pid % 3 WHEN 0 THEN 'C:/other' WHEN 1 THEN '' ELSE 'x' END"


@_query(f"SELECT seq, CASE WHEN k % 5 IN (0, 2) AND pid % 3 = 0 THEN 'C:/other' ELSE {_DECLARED} END AS image FROM v")
def layout_choice(spark, sf_dir):
    return flat(spark, sf_dir).select("seq", C.chosen_layout(F.expr(_DECLARED), F.expr(_OTHER)).alias("image"))


@_query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the on') OR contains(replace(lower(text), '\\\\', '\\'), 'the on')")
def text_contains(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where(C.text_contains(F.col("text"), "The ON")).select("doc_id")


# Filters


def _seqs(rows: DataFrame) -> DataFrame:
    return rows.select("seq")


@_query("SELECT seq FROM v WHERE pid = 7")
def filter_pid(spark, sf_dir):
    return _seqs(filters.query(telemetry(spark, sf_dir), None, pid=7))


@_query("SELECT seq FROM v WHERE process_key = '7:2'")
def filter_process_key(spark, sf_dir):
    return _seqs(filters.query(telemetry(spark, sf_dir), None, process_key="7:2"))


@_query("SELECT seq FROM v WHERE category = 'Network'")
def filter_category(spark, sf_dir):
    return _seqs(filters.query(telemetry(spark, sf_dir), None, category="NETWORK"))


@_query("SELECT seq FROM v WHERE rule_id = 'R-2'")
def filter_rule(spark, sf_dir):
    return _seqs(filters.query(telemetry(spark, sf_dir), None, rule="R-2"))


@_query("SELECT seq FROM v WHERE source_type = 'etw' AND source_detail = 'Microsoft-Windows-Kernel-P1'")
def filter_source(spark, sf_dir):
    return _seqs(filters.query(telemetry(spark, sf_dir), None, source="kernel-p1"))


@_query("SELECT seq FROM v WHERE severity IN ('High', 'Critical')")
def filter_severity(spark, sf_dir):
    return _seqs(filters.query(telemetry(spark, sf_dir), None, severity="high"))


@_query("SELECT seq FROM v WHERE image_path LIKE '%certutil%' OR query_name LIKE 'h7.%'")
def filter_contains(spark, sf_dir):
    """On the JSON text of the data, where backslashes are escaped."""
    rows = telemetry(spark, sf_dir).withColumn("raw", F.to_json("data"))
    hit = rows.where(filters.event_filter(contains="bin\\CertUtil") | filters.event_filter(contains='"h7.'))
    return _seqs(hit)


@_query("SELECT seq FROM v WHERE event_ts >= TIMESTAMP '2024-01-03 00:00:00' AND event_ts <= TIMESTAMP '2024-01-09 12:00:00'")
def filter_time(spark, sf_dir):
    return _seqs(filters.query(telemetry(spark, sf_dir), None, since="2024-01-03 00:00:00", until="2024-01-09 12:00:00"))


@_query("SELECT seq FROM v WHERE category = 'Network' AND severity_ord >= 2 AND source_type = 'sysmon' ORDER BY event_ts, seq LIMIT 100")
def query_combined(spark, sf_dir):
    return _seqs(filters.query(telemetry(spark, sf_dir), category="network", severity="med", source="sysmon"))


@_query("SELECT seq, pid, type FROM v WHERE seq = 77")
def find_by_id(spark, sf_dir):
    return filters.find_by_id(telemetry(spark, sf_dir), "e000000077").select("seq", "data.pid", "data.type")


@_query("SELECT id AS event_id, seq, pid, process_key, category, source_type, source_detail, rule_id, severity, severity_ord FROM v")
def event_index(spark, sf_dir):
    """Events that arrive twice have one row."""
    events = telemetry(spark, sf_dir)
    again = events.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
    return index.projection(events.unionByName(again)).drop("event_ts")


@_query("SELECT seq FROM v WHERE pid = 12 AND event_ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-02-20 00:00:00'")
def lookup_key_window(spark, sf_dir):
    path = shared_path(spark, "index")
    index.rebuild(telemetry(spark, sf_dir), path)
    return _seqs(index.lookup(spark.read.parquet(path), "2024-01-02 00:00:00", "2024-02-20 00:00:00", pid=12))


@_query("SELECT seq FROM v WHERE category = 'Network' AND severity_ord >= 2 AND source_type = 'sysmon' AND event_ts >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY event_ts, seq LIMIT 100")
def index_query(spark, sf_dir):
    events, path = telemetry(spark, sf_dir), shared_path(spark, "index")
    index.rebuild(events, path)
    return _seqs(index.query(spark, path, events, category="network", severity="med", source="sysmon", since="2024-01-05 00:00:00"))


@_query("SELECT seq, pid, type FROM v WHERE seq = 77")
def index_event(spark, sf_dir):
    """An event by its id, after an update that brings a third of the events again."""
    events, path = telemetry(spark, sf_dir), shared_path(spark, "index")
    index.rebuild(events.where("seq % 2 = 0"), path)
    index.update(events.where("seq % 3 < 2"), path)
    return index.event(spark, path, events, "e000000077").select("seq", "data.pid", "data.type")


@_query("SELECT day, count(*) AS n FROM (SELECT CAST(event_ts AS DATE) AS day FROM v) GROUP BY day")
def index_days(spark, sf_dir):
    """Events a day in an index that was updated with all events, half of which it had."""
    events, path = telemetry(spark, sf_dir), shared_path(spark, "index")
    index.rebuild(events.where("seq % 2 = 0"), path)
    index.update(events, path)
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"))


# Statistics


@_query(f"SELECT count(*) AS total_events, strftime(min(event_ts), '%Y-%m-%d %H:%M:%S.%f') AS earliest, strftime(max(event_ts), '%Y-%m-%d %H:%M:%S.%f') AS latest, CAST(floor(epoch(max(event_ts) - min(event_ts)) / 3600) AS BIGINT) AS hours, CAST(floor(epoch(max(event_ts) - min(event_ts)) / 60) AS BIGINT) % 60 AS minutes FROM v")
def stats_totals(spark, sf_dir):
    return stats.totals(telemetry(spark, sf_dir)).select("total_events", _time("earliest"), _time("latest"), "hours", "minutes")


@_query("SELECT category AS label, count(*) AS n FROM v GROUP BY 1")
def stats_category(spark, sf_dir):
    return stats.by_category(telemetry(spark, sf_dir))


@_query("SELECT severity AS label, count(*) AS n FROM v GROUP BY 1")
def stats_severity(spark, sf_dir):
    return stats.by_severity(telemetry(spark, sf_dir))


@_query("SELECT CASE source_type WHEN 'etw' THEN 'ETW/' || source_detail WHEN 'sysmon' THEN 'Sysmon/' || source_detail WHEN 'evasion' THEN 'EvasionDetector' ELSE 'Sensor' END AS label, count(*) AS n FROM v GROUP BY 1")
def stats_source(spark, sf_dir):
    return stats.by_source(telemetry(spark, sf_dir))


@_query("SELECT rule_id AS label, count(*) AS n FROM v WHERE rule_id IS NOT NULL GROUP BY 1")
def stats_rules(spark, sf_dir):
    return stats.by_rule(telemetry(spark, sf_dir))


@_query(f"SELECT {PKEY} AS pkey, arg_min(pid, seq) AS pid, arg_min(context_image, seq) FILTER (WHERE context_image IS NOT NULL) AS image, count(*) AS n FROM v GROUP BY 1 ORDER BY n DESC, pkey LIMIT 10")
def stats_processes(spark, sf_dir):
    return stats.top_processes(telemetry(spark, sf_dir))


# Indicators


_IPS = f"""s AS (
  SELECT 'ip' AS kind, dst_addr AS value, {BASE} AS source, event_ts FROM v WHERE type = 'NetworkConnect' AND {PUBLIC}
  UNION ALL
  SELECT 'ip', trim(x), 'DNS/' || query_name, event_ts FROM (SELECT query_name, event_ts, unnest(string_split(response, ';')) AS x FROM v WHERE query_name <> '' AND response IS NOT NULL) WHERE trim(x) LIKE '93.%'
  UNION ALL
  SELECT 'domain', query_name, 'DnsQuery', event_ts FROM v WHERE query_name <> ''
  UNION ALL
  SELECT 'hash', trim(x), source, event_ts FROM (SELECT CASE type WHEN 'ProcessCreate' THEN {BASE} ELSE image_name END AS source, event_ts, unnest(string_split(hashes, ',')) AS x FROM v WHERE hashes IS NOT NULL))"""
_IOC = "SELECT kind, value, count(*) AS n, strftime(min(event_ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM s {} GROUP BY 1, 2"


def _iocs(spark, sf_dir, kind):
    return iocs.indicators(telemetry(spark, sf_dir), kind).select("kind", "value", "n", _time("first_seen"), "sources")


@_query(_IOC.format("WHERE kind = 'ip'"), _IPS)
def ioc_ips(spark, sf_dir):
    return _iocs(spark, sf_dir, "ip")


@_query(_IOC.format("WHERE kind = 'domain'"), _IPS)
def ioc_domains(spark, sf_dir):
    return _iocs(spark, sf_dir, "domain")


@_query(_IOC.format("WHERE kind = 'hash'"), _IPS)
def ioc_hashes(spark, sf_dir):
    return _iocs(spark, sf_dir, "hash")


@_query("SELECT kind, value, n, rank FROM (SELECT kind, value, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, value) AS rank FROM s GROUP BY 1, 2) WHERE rank <= 5", _IPS)
def ioc_topk(spark, sf_dir):
    return iocs.top_indicators(telemetry(spark, sf_dir), limit=5).select("kind", "value", "n", "rank")


# Hunting and scores


_PARENTS = "('winword.exe', 'excel.exe')"
_CHILDREN = "('cmd.exe', 'powershell.exe', 'certutil.exe', 'mshta.exe')"
_ASOF = f"""c AS (SELECT seq, event_ts, agent_id, pid, ppid, {PKEY} AS pkey, image_path, command_line, {BASE} AS base FROM v WHERE type = 'ProcessCreate'),
a AS (SELECT c.*, (SELECT p.image_path FROM c p WHERE p.agent_id = c.agent_id AND p.pid = c.ppid AND (p.event_ts < c.event_ts OR (p.event_ts = c.event_ts AND p.seq < c.seq)) ORDER BY p.event_ts DESC, p.seq DESC LIMIT 1) AS parent_image FROM c)"""
_ASOF_BASE = "regexp_extract(parent_image, '[^/\\\\]*$', 0)"
_FOUND = f"""f AS (
  SELECT seq, event_ts, 'suspicious-parent' AS rule, 'High' AS severity, 3 AS o, 'T1204.002' AS mitre, pid, pkey, image_path AS image, {_ASOF_BASE} || ' spawned ' || base || ' (' || command_line || ')' AS detail
    FROM a WHERE lower({_ASOF_BASE}) IN {_PARENTS} AND lower(base) IN {_CHILDREN}
  UNION ALL
  SELECT seq, event_ts, 'lolbin', 'Medium', 2, 'T1218', pid, pkey, image_path, 'LOLBin execution: ' || base || ' (' || command_line || ')' FROM c WHERE lower(base) IN {_LOLBINS}
  UNION ALL
  SELECT seq, event_ts, 'unsigned-dll', 'Low', 1, 'T1574.001', pid, {PKEY}, coalesce(context_image, 'PID ' || CAST(pid AS VARCHAR)), 'Unsigned DLL loaded: ' || image_name || ' (' || image_path || ')' FROM v WHERE type = 'ImageLoad' AND NOT signed
  UNION ALL
  SELECT seq, event_ts, 'beaconing', 'Medium', 2, 'T1071.001', pid, pkey, image, CAST(n AS VARCHAR) || ' connections to ' || dst_addr || ' from ' || regexp_extract(image, '[^/\\\\]*$', 0) FROM (
    SELECT dst_addr, {PKEY} AS pkey, count(*) AS n, min(event_ts) AS event_ts, min(seq) AS seq, arg_min(pid, seq) AS pid, arg_min(image_path, seq) AS image FROM v WHERE type = 'NetworkConnect' AND {PUBLIC} GROUP BY 1, 2) WHERE n >= 3)"""
_FIND = "SELECT seq, rule, severity, mitre, pid, pkey, image, detail FROM f WHERE rule = '{}'"
_FINDING = ("seq", "rule", "severity", "mitre", "pid", "pkey", "image", "detail")


@_query("SELECT seq, pid, ppid, pkey, image_path, parent_image FROM a", _ASOF)
def parent_asof(spark, sf_dir):
    return hunt.with_parent(hunt.creations(telemetry(spark, sf_dir))).select("seq", "pid", "ppid", "pkey", "image_path", "parent_image")


@_query(_FIND.format("suspicious-parent"), f"{_ASOF}, {_FOUND}")
def hunt_suspicious_parent(spark, sf_dir):
    return hunt.suspicious_parent(telemetry(spark, sf_dir), RULES).select(*_FINDING)


@_query(_FIND.format("lolbin"), f"{_ASOF}, {_FOUND}")
def hunt_lolbin(spark, sf_dir):
    return hunt.lolbin(telemetry(spark, sf_dir), RULES).select(*_FINDING)


@_query(_FIND.format("unsigned-dll"), f"{_ASOF}, {_FOUND}")
def hunt_unsigned_dll(spark, sf_dir):
    return hunt.unsigned_dll(telemetry(spark, sf_dir)).select(*_FINDING)


@_query(_FIND.format("beaconing"), f"{_ASOF}, {_FOUND}")
def hunt_beaconing(spark, sf_dir):
    return hunt.beaconing(telemetry(spark, sf_dir), RULES).select(*_FINDING)


@_query("SELECT seq, rule, severity, mitre, pid, pkey, image, detail FROM f ORDER BY o DESC, event_ts, rule, seq LIMIT 50", f"{_ASOF}, {_FOUND}")
def hunt_all(spark, sf_dir):
    return hunt.hunt(telemetry(spark, sf_dir), RULES).select(*_FINDING)


_SIGNALS = f"""{_ASOF},
i AS (
  SELECT coalesce(process_key, 'pid:' || CAST(pid AS VARCHAR)) AS pkey, seq, pid, type, rule_id, image_path, dst_addr, query_name,
    CASE type WHEN 'ProcessCreate' THEN image_path WHEN 'EvasionDetected' THEN coalesce(context_image, '') ELSE coalesce(context_image, 'PID ' || CAST(pid AS VARCHAR)) END AS image
  FROM v WHERE type = 'ProcessCreate' OR rule_id IS NOT NULL OR (type = 'ImageLoad' AND NOT signed) OR (type = 'NetworkConnect' AND {PUBLIC}) OR (type = 'DnsQuery' AND query_name <> '')),
w AS (
  SELECT pkey, arg_min(pid, seq) AS pid, arg_min(image, seq) AS image, count(*) FILTER (WHERE type = 'EvasionDetected') AS detections,
    coalesce(bool_or(lower({BASE}) IN {_LOLBINS}) FILTER (WHERE type = 'ProcessCreate'), false) AS lolbin, count(*) FILTER (WHERE type = 'ImageLoad') AS unsigned_dlls,
    count(DISTINCT dst_addr) FILTER (WHERE type = 'NetworkConnect') AS external_ips, count(DISTINCT query_name) FILTER (WHERE type = 'DnsQuery') AS dns_queries,
    pkey IN (SELECT pkey FROM a WHERE lower({_ASOF_BASE}) IN {_PARENTS} AND lower(base) IN {_CHILDREN}) AS suspicious_parent
  FROM i GROUP BY pkey)"""


@_query("SELECT pkey, pid, image, detections, lolbin, unsigned_dlls, external_ips, dns_queries, suspicious_parent FROM w", _SIGNALS)
def score_breakdown(spark, sf_dir):
    return score.breakdown(telemetry(spark, sf_dir), RULES)


@_query("SELECT * FROM (SELECT pkey, pid, image, CAST(detections * 40 + CAST(suspicious_parent AS INT) * 20 + CAST(lolbin AS INT) * 20 + unsigned_dlls * 5 + external_ips * 2 + dns_queries AS BIGINT) AS score FROM w) WHERE score > 0 ORDER BY score DESC, pkey LIMIT 20", _SIGNALS)
def score_processes(spark, sf_dir):
    return score.scores(telemetry(spark, sf_dir), RULES)


# Trees


_EDGES = f"""c AS (SELECT seq, event_ts, agent_id, pid, ppid FROM v WHERE type = 'ProcessCreate'),
e AS (SELECT c.*, (SELECT max(p.seq) FROM c p WHERE p.agent_id = c.agent_id AND p.pid = c.ppid AND p.event_ts <= c.event_ts AND p.seq <> c.seq) AS parent_seq FROM c)"""
_DOWN = "t AS (SELECT seq AS root, seq, pid, ppid, 0 AS depth, [seq] AS path FROM e WHERE parent_seq IS NULL UNION ALL SELECT t.root, e.seq, e.pid, e.ppid, t.depth + 1, list_append(t.path, e.seq) FROM t JOIN e ON e.parent_seq = t.seq WHERE NOT list_contains(t.path, e.seq))"
_UP = "t AS (SELECT seq AS root, seq, pid, ppid, parent_seq, 0 AS depth FROM e WHERE pid = 7 UNION ALL SELECT t.root, e.seq, e.pid, e.ppid, e.parent_seq, t.depth + 1 FROM t JOIN e ON e.seq = t.parent_seq WHERE t.ppid <> 0 AND t.ppid <> t.pid)"


@_query("SELECT seq, pid, ppid, parent_seq FROM e", _EDGES)
def tree_edges(spark, sf_dir):
    return tree.edges(telemetry(spark, sf_dir)).select("seq", "pid", "ppid", "parent_seq")


def _edge_table(spark, sf_dir):
    return written(tree.edges(telemetry(spark, sf_dir)), "edges")


@_query("SELECT root, seq, pid, ppid, depth FROM t", f"{_EDGES}, {_DOWN}")
def tree_descendants(spark, sf_dir):
    """Of all processes without a parent."""
    edge = _edge_table(spark, sf_dir)
    return tree.descendants(edge, edge.where("parent_seq IS NULL").select("seq"))


@_query("SELECT root, count(*) - 1 AS n FROM t GROUP BY root", f"{_EDGES}, {_DOWN}")
def tree_count(spark, sf_dir):
    return tree_descendants(spark, sf_dir).groupBy("root").agg((F.count("*") - 1).alias("n"))


@_query("SELECT root, seq, pid, ppid, depth FROM t", f"{_EDGES}, {_UP}")
def tree_ancestors(spark, sf_dir):
    edge = _edge_table(spark, sf_dir)
    return tree.ancestors(edge, edge.where("pid = 7").select("seq"))


_PLACES = """o AS (SELECT seq AS root, seq, 0 AS depth, [seq] AS path, [strftime(event_ts, '%Y%m%d%H%M%S%f') || lpad(CAST(seq AS VARCHAR), 12, '0')] AS k FROM e WHERE parent_seq IS NULL
  UNION ALL SELECT o.root, e.seq, o.depth + 1, list_append(o.path, e.seq), list_append(o.k, strftime(e.event_ts, '%Y%m%d%H%M%S%f') || lpad(CAST(e.seq AS VARCHAR), 12, '0')) FROM o JOIN e ON e.parent_seq = o.seq WHERE NOT list_contains(o.path, e.seq)),
p AS (SELECT root, seq, depth, row_number() OVER (PARTITION BY root ORDER BY k) AS place FROM o)"""
_JSON = """q AS (SELECT p.*, lag(depth) OVER (PARTITION BY root ORDER BY place) AS before, lead(depth) OVER (PARTITION BY root ORDER BY place) AS after, '{"pid":' || pid || ',"ppid":' || ppid
    || CASE WHEN image_path IS NULL THEN '' ELSE ',"image_path":' || CAST(to_json(image_path) AS VARCHAR) END || CASE WHEN command_line IS NULL THEN '' ELSE ',"command_line":' || CAST(to_json(command_line) AS VARCHAR) END || ',"user":"user"'
    || ',"timestamp":"' || strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '"' || CASE WHEN process_key IS NULL THEN '' ELSE ',"process_key":' || CAST(to_json(process_key) AS VARCHAR) END AS facts
  FROM p JOIN v USING (seq))"""


@_query("SELECT root, seq, depth, place FROM p", f"{_EDGES}, {_PLACES}")
def tree_preorder(spark, sf_dir):
    edge = _edge_table(spark, sf_dir)
    return tree.preorder(tree.descendants(edge, edge.where("parent_seq IS NULL").select("seq")), edge)


@_query("""SELECT root, string_agg(CASE WHEN before >= depth THEN ',' ELSE '' END || facts || CASE WHEN after > depth THEN ',"children":[' ELSE '}' || repeat(']}', CAST(depth - coalesce(after, 0) AS INT)) END, '' ORDER BY place) AS json FROM q GROUP BY root""", f"{_EDGES}, {_PLACES}, {_JSON}")
def tree_json(spark, sf_dir):
    """Trees of all processes without a parent as JSON, at any depth."""
    edge, events = _edge_table(spark, sf_dir), telemetry(spark, sf_dir)
    return tree.as_json(tree.descendants(edge, edge.where("parent_seq IS NULL").select("seq")), edge, events)


@_query("SELECT pid, max(seq) AS seq FROM v WHERE type = 'ProcessCreate' GROUP BY agent_id, pid")
def latest_instance(spark, sf_dir):
    return tree.latest_instance(telemetry(spark, sf_dir)).select("pid", "seq")


# Around an event


_TARGET = "z AS (SELECT id AS t_id, seq AS t_seq, event_ts AS t_ts, process_key AS t_key, agent_id AS t_agent, pid AS t_pid, type AS t_type, technique AS t_tech FROM v WHERE type IN ('ScriptBlock', 'AmsiScan', 'EvasionDetected') AND {} ORDER BY seq LIMIT 1)"
_NEAR = "v.agent_id = t_agent AND v.event_ts BETWEEN t_ts - INTERVAL 3 DAY AND t_ts + INTERVAL 3 DAY"
_MINUTES = 3 * 24 * 60


def _target(events: DataFrame, keyed: bool) -> DataFrame:
    context = F.col("process_context").isNotNull() if keyed else F.col("process_context").isNull()
    return events.where(F.col("data.type").isin("ScriptBlock", "AmsiScan", "EvasionDetected") & context).orderBy("seq").limit(1)


@_query(f"SELECT seq, type FROM v, z WHERE {_NEAR} AND v.pid = t_pid AND type NOT IN ('ProcessCreate', 'ProcessTerminate')", _TARGET.format("process_key IS NULL"))
def explain_timeline(spark, sf_dir):
    """Around an event without a process key."""
    events = telemetry(spark, sf_dir)
    return explain.timeline(events, _target(events, False), _MINUTES).select("seq", "data.type")


@_query(f"SELECT seq, type FROM v, z WHERE {_NEAR} AND v.process_key = t_key AND v.seq <> t_seq", _TARGET.format("process_key IS NOT NULL"))
def bundle_related(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    return explain.related(events, _target(events, True), _MINUTES).select("seq", "data.type")


@_query(f"SELECT 'evidence-bundle' AS format, 1 AS version, {_MINUTES} AS window_minutes, count(*) AS event_count, strftime(min(event_ts), '%Y-%m-%d %H:%M:%S.%f') AS earliest, strftime(max(event_ts), '%Y-%m-%d %H:%M:%S.%f') AS latest, any_value(t_id) AS target_id FROM v, z WHERE {_NEAR} AND v.process_key = t_key", _TARGET.format("process_key IS NOT NULL"))
def bundle_manifest(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    return explain.manifest(events, _target(events, True), _MINUTES).select("format", "version", "window_minutes", "event_count", _time("earliest"), _time("latest"), "target_id")


_SCRIPT = f"SELECT {{}} FROM v, z WHERE {_NEAR.replace('3 DAY', '60 DAY')} AND v.pid = t_pid AND type IN ('ScriptBlock', 'AmsiScan') AND (t_type <> 'EvasionDetected' OR t_tech = 'AmsiBypass')"
_SCRIPT_TARGET = _TARGET.format("process_key IS NULL AND (technique IS NULL OR technique = 'AmsiBypass')")


def _script(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    about = C.is_script_related(F.col("data")) & F.col("process_context").isNull()
    return explain.script_activity(events, events.where(about).orderBy("seq").limit(1), 60 * 24 * 60)


@_query(_SCRIPT.format("seq, type"), _SCRIPT_TARGET)
def explain_script(spark, sf_dir):
    return _script(spark, sf_dir).select("seq", "data.type")


@_query(_SCRIPT.format("count(*) FILTER (WHERE type = 'ScriptBlock') AS script_blocks, count(*) FILTER (WHERE type = 'AmsiScan') AS scans, count(*) FILTER (WHERE scan_result >= 32768) AS detected"), _SCRIPT_TARGET)
def explain_script_counts(spark, sf_dir):
    return explain.script_counts(_script(spark, sf_dir))


@_query("SELECT seq, row_number() OVER (ORDER BY event_ts, seq) AS place FROM v")
def replay_order(spark, sf_dir):
    return replay.replay_places(telemetry(spark, sf_dir).select("seq", "event_ts")).select("seq", "place")


@_query("SELECT seq, CAST(floor(epoch_us(event_ts) - epoch_us(lag(event_ts) OVER (PARTITION BY agent_id ORDER BY event_ts, seq))) AS BIGINT) // 2 AS gap_us FROM v")
def replay_gaps(spark, sf_dir):
    return replay.replay_gaps(telemetry(spark, sf_dir), 2.0).select("seq", "gap_us")


# Arrival order


_SLOT = """o AS (
  SELECT seq, agent_id, pid, type, create_time, image_path, row_number() OVER (PARTITION BY agent_id, pid ORDER BY seq) AS rn,
    CAST(pid AS VARCHAR) || ':' || CAST(coalesce(create_time, 0) AS VARCHAR) AS own FROM v),
r AS (
  SELECT agent_id, pid, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS image, false AS strong, CAST(NULL AS VARCHAR) AS context_key, CAST(NULL AS VARCHAR) AS context_image FROM (SELECT DISTINCT agent_id, pid FROM v)
  UNION ALL
  SELECT agent_id, pid, rn, seq,
    CASE WHEN type = 'ProcessCreate' AND NOT keeps THEN own WHEN ends THEN NULL ELSE key END,
    CASE WHEN type = 'ProcessCreate' AND NOT keeps THEN image_path WHEN ends THEN NULL ELSE image END,
    CASE WHEN type = 'ProcessCreate' AND NOT keeps THEN create_time IS NOT NULL WHEN ends THEN false ELSE strong END,
    CASE WHEN type = 'ProcessCreate' THEN CASE WHEN keeps THEN key ELSE own END WHEN type = 'ProcessTerminate' THEN CASE WHEN ends THEN key END ELSE key END,
    CASE WHEN type = 'ProcessCreate' THEN NULL WHEN type = 'ProcessTerminate' THEN CASE WHEN ends THEN image END ELSE image END
  FROM (
    SELECT o.*, r.key, r.image, r.strong, o.create_time IS NULL AND r.strong AS keeps,
      o.type = 'ProcessTerminate' AND r.key IS NOT NULL AND CASE WHEN o.create_time IS NULL THEN NOT r.strong ELSE r.key = o.own END AS ends
    FROM r JOIN o ON o.agent_id = r.agent_id AND o.pid = r.pid AND o.rn = r.rn + 1))"""


@_query("SELECT seq, context_key, context_image FROM r WHERE rn > 0", _SLOT)
def enrich_context(spark, sf_dir):
    return arrival.enriched(telemetry(spark, sf_dir))


_CANDIDATE = ("seq", "rule", "severity", "mitre", "pkey", "pid", "image", "detail", "dedup")


def _candidates(spark, sf_dir, test: str) -> DataFrame:
    return arrival.alert_candidates(telemetry(spark, sf_dir), RULES).where(test).select(*_CANDIDATE)


@_query(f"SELECT seq, rule_id AS rule, severity, 'T100' || substr(rule_id, 3, 1) AS mitre, {PKEY} AS pkey, pid, coalesce(context_image, '') AS image, 'EvasionDetected   pid:' || CAST(pid AS VARCHAR) || ' ' || technique || ' patched' AS detail, {PKEY} || '|' || rule_id AS dedup FROM v WHERE rule_id IS NOT NULL")
def alert_detection(spark, sf_dir):
    return _candidates(spark, sf_dir, "alert_type = 'detection'")


@_query("SELECT seq, rule, severity, mitre, pkey, pid, image, detail, pkey || '|lolbin' AS dedup FROM f WHERE rule = 'lolbin'", f"{_ASOF}, {_FOUND}")
def alert_lolbin(spark, sf_dir):
    return _candidates(spark, sf_dir, "rule = 'lolbin'")


@_query("SELECT f.seq, rule, f.severity, mitre, pkey, f.pid, image, detail, pkey || '|unsigned-dll|' || image_name AS dedup FROM f JOIN v ON v.seq = f.seq WHERE rule = 'unsigned-dll'", f"{_ASOF}, {_FOUND}")
def alert_unsigned(spark, sf_dir):
    return _candidates(spark, sf_dir, "rule = 'unsigned-dll'")


_COOL = """k AS (SELECT seq, epoch_us(event_ts) AS us, agent_id, rule_id, row_number() OVER (PARTITION BY agent_id, rule_id ORDER BY event_ts, seq) AS rn FROM v WHERE rule_id IS NOT NULL),
q AS (
  SELECT seq, agent_id, rule_id, rn, us AS prev, true AS kept FROM k WHERE rn = 1
  UNION ALL
  SELECT k.seq, k.agent_id, k.rule_id, k.rn, CASE WHEN k.us - q.prev >= {0} THEN k.us ELSE q.prev END, k.us - q.prev >= {0}
  FROM q JOIN k ON k.agent_id = q.agent_id AND k.rule_id = q.rule_id AND k.rn = q.rn + 1)"""


@_query("SELECT seq FROM q WHERE kept", _COOL.format("86400000000"))
def alert_cooldown(spark, sf_dir):
    """A day between detections of one rule on one agent."""
    rows = arrival.alert_candidates(telemetry(spark, sf_dir), RULES).where("alert_type = 'detection'")
    return arrival.cooled(rows, 86_400, ["agent_id", "rule"]).select("seq")


@_query("SELECT seq FROM q WHERE kept", _COOL.format("60000000"))
def ti_throttle(spark, sf_dir):
    """A minute between passes of one rule on one agent."""
    rows = arrival.alert_candidates(telemetry(spark, sf_dir), RULES).where("alert_type = 'detection'")
    return arrival.cooled(rows, 60, ["agent_id", "rule"]).select("seq")


_R = RULES
_WAIT = _R.cooldown


def _cooled(name: str, rows: str) -> str:
    """CTEs: of `rows` (agent_id, dedup, n, ord, tm, ...) those that pass, as `name`."""
    return f"""{name}_k AS (SELECT *, row_number() OVER (PARTITION BY agent_id, dedup ORDER BY n, ord) AS rn FROM {rows}),
{name}_q AS (
  SELECT agent_id, dedup, rn, tm AS passed, true AS kept FROM {name}_k WHERE rn = 1
  UNION ALL
  SELECT k.agent_id, k.dedup, k.rn, CASE WHEN k.tm - q.passed >= {_WAIT} THEN k.tm ELSE q.passed END, k.tm - q.passed >= {_WAIT}
  FROM {name}_q q JOIN {name}_k k ON k.agent_id = q.agent_id AND k.dedup = q.dedup AND k.rn = q.rn + 1),
{name} AS (SELECT k.* FROM {name}_k k JOIN {name}_q q USING (agent_id, dedup, rn) WHERE q.kept)"""


def _alerts(order: str) -> str:
    """CTEs ending in `alerts`: all alerts of each agent's events in an order, each rule a set of rows and not a walk.

    Only the cooldowns recur. A child that came before any process of its ppid waits for the first suspicious
    parent of that pid after it.
    """
    return f"""e AS (
  SELECT seq, agent_id, epoch_us(event_ts) / 1e6 AS tm, type, {PKEY} AS pkey, pid, ppid, command_line, rule_id, severity, technique, image_name, image_path, {BASE} AS base,
    CASE WHEN {PUBLIC} THEN dst_addr END AS ip, nullif(query_name, '') AS name,
    CASE type WHEN 'ProcessCreate' THEN image_path WHEN 'EvasionDetected' THEN coalesce(context_image, '') ELSE coalesce(context_image, 'PID ' || CAST(pid AS VARCHAR)) END AS image,
    row_number() OVER (PARTITION BY agent_id ORDER BY {order}) AS n
  FROM v WHERE type IN ('ProcessCreate', 'NetworkConnect', 'DnsQuery') OR rule_id IS NOT NULL OR (type = 'ImageLoad' AND NOT signed)),
made AS (SELECT * FROM e WHERE type = 'ProcessCreate'),
risky AS (
  SELECT m.*, (SELECT max(p.n) FROM made p WHERE p.agent_id = m.agent_id AND p.pid = m.ppid AND p.n < m.n) AS before,
    (SELECT min(p.n) FROM made p WHERE p.agent_id = m.agent_id AND p.pid = m.ppid AND p.n > m.n AND lower(p.base) IN {_PARENTS}) AS after
  FROM made m WHERE lower(base) IN {_CHILDREN}),
spawned AS (
  SELECT p.agent_id, greatest(p.n, c.n) AS n, c.n AS child, CASE WHEN p.n > c.n THEN p.seq ELSE c.seq END AS seq, greatest(p.n, c.n) = p.n AS late, p.tm AS parent_tm, c.tm AS about, c.pkey, c.pid, c.image_path AS image, p.base || ' spawned ' || c.base || ' (' || c.command_line || ')' AS detail
  FROM risky c JOIN made p ON p.agent_id = c.agent_id AND p.n = CASE WHEN c.before IS NULL THEN c.after ELSE c.before END
  WHERE lower(p.base) IN {_PARENTS} AND p.tm <= c.tm),
raw AS (
  SELECT agent_id, n, 0 AS ord, seq, 'hunt' AS alert_type, 'lolbin' AS rule, 'Medium' AS severity, 'T1218' AS mitre, pkey, pid, image, 'LOLBin execution: ' || base || ' (' || command_line || ')' AS detail, pkey || '|lolbin' AS dedup, tm, tm AS about FROM made WHERE lower(base) IN {_LOLBINS}
  UNION ALL
  SELECT agent_id, n, child, seq, 'hunt', 'suspicious-parent', 'High', 'T1204.002', pkey, pid, image, detail, pkey || '|suspicious-parent', CASE WHEN late THEN parent_tm ELSE about END, about FROM spawned
  UNION ALL
  SELECT agent_id, n, 0, seq, 'detection', rule_id, severity, 'T100' || substr(rule_id, 3, 1), pkey, pid, image, 'EvasionDetected   pid:' || CAST(pid AS VARCHAR) || ' ' || technique || ' patched', pkey || '|' || rule_id, tm, tm FROM e WHERE rule_id IS NOT NULL
  UNION ALL
  SELECT agent_id, n, 0, seq, 'hunt', 'unsigned-dll', 'Low', 'T1574.001', pkey, pid, image, 'Unsigned DLL loaded: ' || image_name || ' (' || image_path || ')', pkey || '|unsigned-dll|' || image_name, tm, tm FROM e WHERE type = 'ImageLoad'),
{_cooled("first", "raw")},
marks AS (
  SELECT agent_id, pkey, n, pid, image, CASE type WHEN 'ProcessCreate' THEN 'create' WHEN 'EvasionDetected' THEN 'detection' WHEN 'ImageLoad' THEN 'unsigned' WHEN 'NetworkConnect' THEN 'ip' ELSE 'name' END AS kind, coalesce(ip, name, lower(base)) AS value
  FROM e WHERE type NOT IN ('NetworkConnect', 'DnsQuery') OR ip IS NOT NULL OR name IS NOT NULL
  UNION ALL SELECT agent_id, pkey, n, pid, image, 'parent', NULL FROM spawned),
touched AS (
  SELECT DISTINCT agent_id, n, seq, pkey FROM first
  UNION SELECT agent_id, n, seq, pkey FROM e WHERE type IN ('NetworkConnect', 'DnsQuery')),
totals AS (
  SELECT t.agent_id, t.n, t.seq, t.pkey, arg_min(m.pid, m.n) AS pid, arg_min(m.image, m.n) AS image,
    count(*) FILTER (WHERE kind = 'detection') * {_R.detection} + count(*) FILTER (WHERE kind = 'unsigned') * {_R.unsigned_dll}
    + CASE WHEN count(*) FILTER (WHERE kind = 'parent') > 0 THEN {_R.suspicious_parent} ELSE 0 END + CASE WHEN count(*) FILTER (WHERE kind = 'create' AND value IN {_LOLBINS}) > 0 THEN {_R.lolbin} ELSE 0 END
    + count(DISTINCT value) FILTER (WHERE kind = 'ip') * {_R.external_ip} + count(DISTINCT value) FILTER (WHERE kind = 'name') * {_R.dns_query} AS total
  FROM touched t JOIN marks m ON m.agent_id = t.agent_id AND m.pkey = t.pkey AND m.n <= t.n GROUP BY 1, 2, 3, 4),
high AS (SELECT t.agent_id, t.n, 0 AS ord, t.seq, t.pkey, t.pid, t.image, t.total, t.pkey || '|score-threshold' AS dedup, e.tm FROM totals t JOIN e ON e.agent_id = t.agent_id AND e.n = t.n WHERE total >= {_R.threshold}),
{_cooled("second", "high")},
alerts AS (
  SELECT seq, alert_type, rule, severity, mitre, pkey, pid, image, detail, CAST(NULL AS BIGINT) AS score, about AS "at" FROM first
  UNION ALL
  SELECT seq, 'score', 'score-threshold', 'High', NULL, pkey, pid, image, 'Process score ' || CAST(total AS VARCHAR) || ' reached threshold {_R.threshold}', CAST(total AS BIGINT), tm FROM second)"""


@_query("SELECT * FROM alerts", _alerts("event_ts, seq"))
def alert_backtest(spark, sf_dir):
    return arrival.backtest(telemetry(spark, sf_dir), RULES)


def _accept(alerts: list[dict]) -> None:
    """Stands for a webhook that fails for every third event."""
    if alerts[0]["seq"] % 3 == 0:
        raise OSError("refused")


@_query("SELECT seq, alert_type, seq % 3 <> 0 AS sent, CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM alerts", _alerts("event_ts, seq"))
def alert_outbox(spark, sf_dir):
    """A micro-batch of alerts that runs twice: what was sent is not posted again, what failed is."""
    alerts, place = written(arrival.backtest(telemetry(spark, sf_dir), RULES), "alerts"), shared_path(spark, "outbox")
    for _ in range(2):
        outbox.post_once(alerts, 0, _accept, place)
    of = lambda name: F.get_json_object("alert", f"$.{name}")
    return outbox.states(outbox.records(spark, place)).select(of("seq").cast("long").alias("seq"), of("alert_type").alias("alert_type"), "sent", "attempts")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry as files that a stream reads."""
    path = shared_path(spark, "telemetry")
    rows = telemetry(spark, sf_dir).drop("k")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(path)


@_query("SELECT * FROM alerts WHERE rule = 'suspicious-parent'", _alerts("seq"))
def alert_suspicious_parent(spark, sf_dir):
    out = jobs.run_to_end(jobs.stream_alerts(_streamed(spark, sf_dir), RULES), "alerts")
    return out.where("rule = 'suspicious-parent'")


@_query("SELECT * FROM alerts WHERE alert_type = 'score'", _alerts("seq"))
def alert_score(spark, sf_dir):
    out = jobs.run_to_end(jobs.stream_alerts(_streamed(spark, sf_dir), RULES), "alerts")
    return out.where("alert_type = 'score'")


@_query("SELECT seq, context_key, context_image FROM r WHERE rn > 0", _SLOT)
def stream_enrich(spark, sf_dir):
    return jobs.run_to_end(jobs.stream_enriched(_streamed(spark, sf_dir)), "contexts")


@_query("SELECT seq, type FROM v WHERE category = 'Dns' AND severity_ord >= 3")
def tail_filtered(spark, sf_dir):
    return jobs.run_to_end(jobs.tail(_streamed(spark, sf_dir), category="dns", severity="HIGH").select("seq", "data.type"), "tail")


# Files of events


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry in the form of event files, with blank and broken lines between."""
    uuid = lambda n: F.concat(F.lpad(F.hex(n), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    source = F.when(F.col("source_type") == "etw", F.concat(F.lit('{"Etw":{"provider":"'), "source_detail", F.lit('"}}'))).when(F.col("source_type") == "sysmon", F.concat(F.lit('{"Sysmon":{"event_id":'), "source_detail", F.lit("}}"))).when(F.col("source_type") == "evasion", "EvasionDetector").otherwise("Sensor")
    # The generator also parts the making of events from that of lines, so that methods stay small (see schema.is_event).
    events = telemetry(spark, sf_dir).withColumn("broken", F.explode(F.when(F.col("seq") % 10 == 3, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    rows = events.withColumns({"id": uuid(F.col("seq")), "timestamp": F.concat(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")), "hostname": F.lit("h"), "agent_id": uuid(F.col("agent_id")), "sensor_version": F.lit("1"), "source": source})
    broken = F.when(F.col("seq") % 20 == 3, "").otherwise('{"id": "x", "data": {')
    return jsonl.as_lines(rows, also=["seq", "broken"]).select(F.when(F.col("broken"), broken).otherwise(F.col("value")).alias("value"))


_VALID = "SELECT lpad(lower(to_hex(seq)), 8, '0') || '-0000-4000-8000-000000000000' AS id, type, category, severity_ord, source_type, source_detail, pid, process_key, rule_id FROM v"


def _facts(events: DataFrame) -> DataFrame:
    return events.select("id", "data.type", "category", "severity_ord", "source_type", "source_detail", "data.pid", "process_context.process_key", F.col("rule.id").alias("rule_id"))


@_query(_VALID)
def scan_events(spark, sf_dir):
    path = shared_path(spark, "lines")
    _lines(spark, sf_dir).write.text(path)
    return _facts(jsonl.read_events(spark, path))


@_query(_VALID)
def stream_scan(spark, sf_dir):
    path = shared_path(spark, "lines")
    _lines(spark, sf_dir).write.text(path)
    return jobs.run_to_end(_facts(jsonl.stream_events(spark, path)), "scan")


@_query(_VALID)
def follow_files(spark, sf_dir):
    """Files that are followed as they grow, here to what is there."""
    path = shared_path(spark, "lines")
    _lines(spark, sf_dir).write.text(path)
    return jobs.run_to_end(_facts(jsonl.follow_events(spark, path)), "followed")


@_query(_VALID)
def sink_jsonl(spark, sf_dir):
    """Events read from lines, written as lines in files of under 200 kB, and read again."""
    path, out = shared_path(spark, "lines"), shared_path(spark, "out")
    _lines(spark, sf_dir).write.text(path)
    jsonl.write_lines(jsonl.read_events(spark, path), out, 200_000)
    return _facts(jsonl.read_events(spark, out))


@_query(_VALID)
def sink_stream(spark, sf_dir):
    """A stream of events written as lines, and read again."""
    path, out = shared_path(spark, "lines"), shared_path(spark, "out")
    _lines(spark, sf_dir).write.text(path)
    jsonl.stream_lines(jsonl.stream_events(spark, path), out, shared_path(spark, "check"), 200_000).trigger(availableNow=True).start().awaitTermination()
    return _facts(jsonl.read_events(spark, out))


@_query("SELECT (seq // 10000) * 10000 + (seq % 10000) // 100 AS batch, count(*) AS n, sum(length(type)) AS chars FROM v GROUP BY 1")
def http_batches(spark, sf_dir):
    lines = telemetry(spark, sf_dir).select("seq", F.concat(F.lit('"'), "data.type", F.lit('"')).alias("value"))
    out = sinks.http_batches(lines)
    return out.select("batch", "n", (F.length("body") - 2 - (F.col("n") - 1) - 2 * F.col("n")).cast("long").alias("chars"))


@_query(
    "SELECT spool, batch, bytes, used FROM d WHERE fits",
    """l AS (SELECT pid % 7 AS spool, seq AS batch, CAST(k AS BIGINT) * 10 + 1 AS bytes, row_number() OVER (PARTITION BY pid % 7 ORDER BY seq) AS rn FROM v),
d AS (
  SELECT spool, batch, bytes, rn, CASE WHEN bytes <= 20000 THEN bytes ELSE 0 END AS used, bytes <= 20000 AS fits FROM l WHERE rn = 1
  UNION ALL
  SELECT l.spool, l.batch, l.bytes, l.rn, CASE WHEN d.used + l.bytes <= 20000 THEN d.used + l.bytes ELSE d.used END, d.used + l.bytes <= 20000
  FROM d JOIN l ON l.spool = d.spool AND l.rn = d.rn + 1)""",
)
def dead_letter_cap(spark, sf_dir):
    """Batches of k * 10 + 1 bytes in seven spools of 20,000 bytes."""
    failed = flat(spark, sf_dir).select((F.col("seq") * 7 + F.col("pid") % 7).alias("batch"), F.repeat(F.lit("x"), F.col("k") * 10 + 1).alias("body"))
    out = sinks.dead_letters(failed, 20_000, 7)
    return out.select("spool", F.floor(F.col("batch") / 7).alias("batch"), "bytes", "used")


# Raw records


@_query("SELECT seq, CASE type WHEN 'ProcessCreate' THEN 1 WHEN 'ProcessTerminate' THEN 5 WHEN 'NetworkConnect' THEN 3 WHEN 'ImageLoad' THEN 7 WHEN 'DnsQuery' THEN 22 WHEN 'EvasionDetected' THEN 25 WHEN 'ScriptBlock' THEN 10 ELSE 99 END AS eid, CAST(pid AS VARCHAR) AS pid, CASE k % 3 WHEN 0 THEN 'Image is replaced' WHEN 1 THEN 'Image is locked for access' ELSE 'Other & more' END AS kind FROM v")
def sysmon_parse(spark, sf_dir):
    rows = normalise.parsed_sysmon(fixtures.sysmon_records(spark, sf_dir))
    of = lambda n: F.try_element_at(F.filter("fields", lambda d: d["name"] == n), F.lit(-1))["value"]
    return rows.select("seq", "eid", of("ProcessId").alias("pid"), of("Type").alias("kind"))


@_query("""SELECT seq, CASE type WHEN 'EvasionDetected' THEN 'Evasion' WHEN 'ScriptBlock' THEN 'Process' ELSE category END AS category,
  CASE type WHEN 'EvasionDetected' THEN 'Critical' WHEN 'ScriptBlock' THEN 'Medium' ELSE 'Info' END AS severity,
  CASE type WHEN 'ScriptBlock' THEN 'ProcessAccess' ELSE type END AS type, CASE WHEN type <> 'ScriptBlock' THEN pid END AS pid,
  CASE WHEN type = 'NetworkConnect' THEN CASE WHEN k % 2 = 0 THEN 'Outbound' ELSE 'Inbound' END END AS direction,
  CASE WHEN type = 'ScriptBlock' THEN CAST(k * 16 AS BIGINT) END AS granted_access,
  CASE WHEN type = 'ImageLoad' THEN image_name END AS image_name, CASE WHEN type = 'ImageLoad' THEN signed END AS signed,
  CASE WHEN type = 'EvasionDetected' THEN CASE k % 3 WHEN 0 THEN 'TF-SYS-001a' WHEN 1 THEN 'TF-SYS-001b' ELSE 'TF-SYS-001' END END AS rule_id
FROM v WHERE type <> 'AmsiScan'""")
def sysmon_normalise(spark, sf_dir):
    rows = normalise.sysmon_events(fixtures.sysmon_records(spark, sf_dir))
    return rows.select("seq", "category", "severity", "data.type", "data.pid", "data.direction", "data.granted_access", "data.image_name", "data.signed", "rule_id")


@_query("""SELECT seq, type, severity2 AS severity, rule_id, direction, signed, signature, response FROM (
  SELECT seq, type, k,
    CASE type WHEN 'ScriptBlock' THEN 'Medium' WHEN 'AmsiScan' THEN CASE WHEN scan_result >= 32768 THEN 'High' ELSE 'Info' END WHEN 'EvasionDetected' THEN CASE WHEN k % 12 BETWEEN 6 AND 8 THEN 'Medium' ELSE 'High' END ELSE 'Info' END AS severity2,
    CASE WHEN type = 'EvasionDetected' AND k % 12 NOT BETWEEN 6 AND 8 THEN CASE WHEN k % 12 BETWEEN 1 AND 10 THEN 'TF-TI-' || lpad(CAST(k % 12 AS VARCHAR), 3, '0') ELSE 'TF-TI-000' END END AS rule_id,
    CASE WHEN type = 'NetworkConnect' THEN CASE WHEN 10 + k % 9 IN (10, 11, 15, 16) THEN 'Outbound' ELSE 'Inbound' END END AS direction,
    CASE WHEN type = 'ImageLoad' THEN k % 8 >= 4 END AS signed,
    CASE WHEN type = 'ImageLoad' AND k % 8 >= 4 THEN CASE k % 9 WHEN 0 THEN 'None' WHEN 1 THEN 'Embedded' WHEN 2 THEN 'Cached' WHEN 3 THEN 'CatalogCached' WHEN 4 THEN 'CatalogNotCached' WHEN 5 THEN 'CatalogHint' WHEN 6 THEN 'PackageCatalog' WHEN 7 THEN 'Type7' ELSE 'Type8' END END AS signature,
    CASE WHEN type = 'DnsQuery' AND k % 2 = 1 AND k % 3 = 0 THEN response END AS response
  FROM v WHERE NOT (type = 'NetworkConnect' AND k % 9 = 4))""")
def etw_normalise(spark, sf_dir):
    rows = normalise.provider_events(fixtures.provider_records(spark, sf_dir))
    return rows.select("seq", "data.type", "severity", "rule_id", "data.direction", "data.signed", "data.signature", "data.response")


# Executables


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each load of the telemetry."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), pe.FILES):
                part = frame[i : i + pe.FILES]
                yield pd.DataFrame({"path": part["path"], "content": [fixtures.sample_image(k) for k in part["k"]]})

    rows = flat(spark, sf_dir).where("type = 'ImageLoad'").select(F.format_string("C:\\m\\f%d.dll", "seq").alias("path"), "k")
    return rows.mapInPandas(build, "path string, content binary")


_PATH = "'C:' || chr(92) || 'm' || chr(92) || 'f' || CAST(seq AS VARCHAR) || '.dll' AS path"
_LOADS = "FROM v WHERE type = 'ImageLoad'"
_CALLS = "unnest(list_slice(['VirtualAllocEx', 'CreateFileW', 'GetProcAddress', 'NtCreateSection', 'WinExec'], 1, k % 6))"


@_query(f"SELECT {_PATH}, k % 11 <> 10 AS valid, CASE WHEN k % 11 <> 10 THEN 'PE32+ (AMD64)' END AS machine, CASE WHEN k % 11 <> 10 THEN CASE WHEN k % 2 = 0 THEN 'Windows GUI' ELSE 'Windows CUI' END END AS subsystem, CASE WHEN k % 11 <> 10 THEN CAST(12288 + k AS BIGINT) END AS image_size, CASE WHEN k % 11 <> 10 THEN k % 6 END AS n_imports {_LOADS}")
def pe_headers(spark, sf_dir):
    return pe.headers(pe.parsed(_files(spark, sf_dir))).select("path", "valid", "machine", "subsystem", "image_size", "n_imports")


@_query(f"SELECT 'f' || CAST(seq AS VARCHAR) || '.dll' AS name, k % 11 <> 10 AS valid, CASE WHEN k % 11 <> 10 THEN 'PE32+ (AMD64)' END AS machine, CASE WHEN k % 11 <> 10 THEN CAST(12288 + k AS BIGINT) END AS image_size, CASE WHEN k % 11 <> 10 THEN k % 6 END AS n_imports, CASE WHEN k % 11 <> 10 AND k % 3 > 0 THEN CAST(k % 3 AS BIGINT) END AS stubs {_LOADS}")
def pe_files(spark, sf_dir):
    """The images as files on disk, read by ranges."""
    found = executables.read_files(spark, fixtures.files_on_disk(_files(spark, sf_dir), shared_path(spark, "images")), code=True)
    head = pe.headers(found, pe.stub_count(F.col("code")).alias("stubs"))
    return head.select(C.basename(F.col("path")).alias("name"), "valid", "machine", "image_size", "n_imports", "stubs")


@_query(f"SELECT {_PATH}, '.text' AS section, CASE WHEN k % 5 = 0 THEN 'RWX' ELSE 'R-X' END AS rights, k % 5 = 0 AS suspicious {_LOADS} AND k % 11 <> 10")
def pe_sections(spark, sf_dir):
    return pe.sections(pe.parsed(_files(spark, sf_dir))).select("path", "section", "rights", "suspicious")


@_query(f"SELECT {_PATH}, 'ntdll.dll' AS dll, {_CALLS} AS name {_LOADS} AND k % 11 <> 10")
def pe_imports(spark, sf_dir):
    return pe.imports(pe.parsed(_files(spark, sf_dir)))


@_query(f"SELECT {_PATH}, 'Run' || CAST(k AS VARCHAR) AS name {_LOADS} AND k % 11 <> 10 AND k % 4 = 1")
def pe_exports(spark, sf_dir):
    return pe.exports(pe.parsed(_files(spark, sf_dir)))


@_query(
    "SELECT path, category, count(*) AS n, string_agg(name, ',' ORDER BY name) AS apis, any_value(files) AS files FROM (SELECT *, count(DISTINCT path) OVER (PARTITION BY category) AS files FROM j) GROUP BY 1, 2",
    f"""x AS (SELECT {_PATH}, {_CALLS} AS name {_LOADS} AND k % 11 <> 10),
y(name, category) AS (VALUES ('VirtualAllocEx', 'Process Injection'), ('VirtualAllocEx', 'Memory Manipulation'), ('GetProcAddress', 'Hooking / Dynamic Resolution'), ('NtCreateSection', 'Defense Evasion'), ('WinExec', 'Code Execution')),
j AS (SELECT path, x.name, category FROM x JOIN y ON x.name = y.name)""",
)
def pe_api_summary(spark, sf_dir):
    return pe.api_summary(pe.parsed(_files(spark, sf_dir)))


@_query(f"SELECT {_PATH}, CAST(k % 3 AS BIGINT) AS stubs, CAST(CASE WHEN k % 2 = 1 THEN k % 3 ELSE 0 END AS BIGINT) AS direct, CAST(CASE WHEN k % 2 = 0 THEN k % 3 ELSE 0 END AS BIGINT) AS indirect {_LOADS} AND k % 11 <> 10 AND k % 3 > 0")
def pe_stubs(spark, sf_dir):
    return pe.stub_findings(pe.parsed(_files(spark, sf_dir), code=True))


@_query("SELECT seq, n, CASE WHEN n > 0 THEN k END AS ssn FROM (SELECT seq, k, k % 4 AS n FROM v WHERE type = 'ImageLoad')")
def syscall_stubs(spark, sf_dir):
    """Stubs at multiples of 20 bytes, with a number over the limit between."""
    low = F.concat(F.lpad(F.hex("k"), 2, "0"), F.lit("000000"))
    good = F.concat(F.lit("4C8BD1B8"), low, F.lit("0F05C3"))
    wrong = F.lit("B801070000498 9CA0F05".replace(" ", ""))
    data = F.unhex(F.concat(wrong, F.repeat(F.concat(good, F.repeat(F.lit("90"), 9)), F.col("k") % 4), F.lit("B8C3")))
    rows = flat(spark, sf_dir).where("type = 'ImageLoad'").select("seq", pe.stubs(data).alias("s"))
    return rows.select("seq", F.size("s").alias("n"), F.when(F.size("s") > 0, F.try_element_at("s", F.lit(1))["ssn"]).alias("ssn"))


@_query("SELECT seq, CASE k % 6 WHEN 0 THEN 'mov-ret E_INVALIDARG' WHEN 1 THEN 'mov-ret imm32' WHEN 2 THEN 'xor-ret' WHEN 3 THEN 'ret' WHEN 4 THEN 'nop-ret' END AS pattern, CASE WHEN k % 6 < 3 THEN 'High' WHEN k % 6 < 5 THEN 'Medium' END AS confidence FROM v")
def prologue_patch(spark, sf_dir):
    code = F.unhex(F.expr("CASE k % 6 WHEN 0 THEN 'B857000780C3' WHEN 1 THEN 'B899000000C3' WHEN 2 THEN '33C0C390' WHEN 3 THEN 'C300' WHEN 4 THEN '90C390' ELSE '4C8BDC49895B08' END"))
    return flat(spark, sf_dir).select("seq", pe.prologue_patch(code).alias("p")).select("seq", "p.*")


def _loads(spark, sf_dir):
    return flat(spark, sf_dir).where("type = 'ImageLoad'").select("seq", "agent_id", "pid", "k", F.format_string("C:\\M\\F%d.DLL", "seq").alias("image_path"))


@_query(f"SELECT seq, pid, 'C:' || chr(92) || 'M' || chr(92) || 'F' || CAST(seq AS VARCHAR) || '.DLL' AS image_path, CAST(k % 3 AS BIGINT) AS stubs, CASE WHEN k % 2 = 1 THEN 'High' ELSE 'Info' END AS severity, CASE WHEN k % 2 = 1 THEN 'TF-EVA-005' END AS rule_id {_LOADS} AND k % 11 <> 10 AND k % 3 > 0")
def imageload_stub_join(spark, sf_dir):
    return pe.loads_with_stubs(_loads(spark, sf_dir), pe.stub_findings(pe.parsed(_files(spark, sf_dir), code=True)))


@_query(
    "SELECT seq, pid, function FROM f WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.agent_id = f.agent_id AND n.pid = f.pid)",
    "f AS (SELECT seq, agent_id, pid, 'ntcreatesection' AS function FROM v WHERE type = 'EvasionDetected'), n AS (SELECT DISTINCT agent_id, pid FROM v WHERE type = 'ImageLoad' AND k % 11 <> 10 AND k % 6 >= 4 AND seq % 8 = 0)",
)
def ti_import_anti(spark, sf_dir):
    calls = flat(spark, sf_dir).where("type = 'EvasionDetected'").select("seq", "agent_id", "pid", F.lit("ntcreatesection").alias("function"))
    modules = _loads(spark, sf_dir).where("seq % 8 = 0")
    return pe.unimported_calls(calls, modules, pe.imports(pe.parsed(_files(spark, sf_dir)))).select("seq", "pid", "function")


@_query("SELECT agent_id, pid, max(k % 3 + CASE WHEN k % 2 = 1 AND k % 3 > 0 THEN 1000 ELSE 0 END) AS rank FROM v WHERE type = 'ImageLoad' AND k % 11 <> 10 AND k % 3 > 0 GROUP BY 1, 2")
def stub_rank(spark, sf_dir):
    found = pe.stub_findings(pe.parsed(_files(spark, sf_dir), code=True)).withColumn("file", F.lower("path"))
    rows = _loads(spark, sf_dir).withColumn("file", F.lower("image_path")).join(found, "file")
    return pe.best_module(rows).select("agent_id", "pid", "rank")
