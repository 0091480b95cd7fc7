"""Events of the table `events` (event_id, ts, user_id, event_type, props) in the engine's schema.

VIEW is SQL for Spark and DuckDB alike; it derives flat telemetry `v` from that table, row by row but for
the number of a pid's creations so far. `telemetry` nests it as read_events does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CONTEXT, DATA, RULE

VIEW = """
WITH b AS (
  SELECT event_id AS seq, ts AS event_ts, user_id AS pid, event_type,
    CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k
  FROM events),
m AS (
  SELECT seq, event_ts, pid, k, CAST(floor(pid / 25) AS BIGINT) AS agent_id,
    CASE event_type WHEN 'signup' THEN 'ProcessCreate'
      WHEN 'purchase' THEN CASE WHEN k % 10 = 9 THEN 'ProcessTerminate' ELSE 'ImageLoad' END
      WHEN 'click' THEN 'NetworkConnect' WHEN 'view' THEN 'DnsQuery'
      ELSE CASE WHEN k % 5 < 4 THEN 'EvasionDetected' WHEN k % 2 = 0 THEN 'ScriptBlock' ELSE 'AmsiScan' END END AS type
  FROM b),
g AS (
  SELECT *, SUM(CASE WHEN type = 'ProcessCreate' THEN 1 ELSE 0 END)
    OVER (PARTITION BY pid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gen,
    'C:' || chr(92) || 'bin' || chr(92) || CASE k % 8 WHEN 0 THEN 'WinWord.exe' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN 'certutil.exe'
      WHEN 3 THEN 'explorer.exe' WHEN 4 THEN 'excel.exe' WHEN 5 THEN 'powershell.exe' WHEN 6 THEN 'svchost.exe' ELSE 'mshta.exe' END AS image
  FROM m),
v AS (
  SELECT seq, 'e' || lpad(CAST(seq AS STRING), 9, '0') AS id, event_ts, agent_id, pid, k, type,
    CASE type WHEN 'ProcessCreate' THEN 'Process' WHEN 'ProcessTerminate' THEN 'Process' WHEN 'ImageLoad' THEN 'ImageLoad'
      WHEN 'NetworkConnect' THEN 'Network' WHEN 'DnsQuery' THEN 'Dns' WHEN 'EvasionDetected' THEN 'Evasion' ELSE 'Script' END AS category,
    k % 5 AS severity_ord,
    CASE k % 5 WHEN 0 THEN 'Info' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Critical' END AS severity,
    CASE k % 4 WHEN 0 THEN 'etw' WHEN 1 THEN 'sysmon' WHEN 2 THEN 'evasion' ELSE 'sensor' END AS source_type,
    CASE k % 4 WHEN 0 THEN 'Microsoft-Windows-Kernel-P' || CAST(k % 3 AS STRING) WHEN 1 THEN CAST(k % 26 + 1 AS STRING) END AS source_detail,
    CASE WHEN k % 6 <> 0 THEN CAST(pid AS STRING) || ':' || CAST(gen AS STRING) END AS process_key,
    CASE WHEN k % 6 <> 0 AND k % 7 <> 0 THEN 'C:' || chr(92) || 'proc' || chr(92) || 'p' || CAST(pid % 40 AS STRING) || '.exe' END AS context_image,
    CASE WHEN type = 'ProcessCreate' THEN agent_id * 25 + (pid + k) % 25 END AS ppid,
    CASE WHEN type IN ('ProcessCreate', 'ProcessTerminate', 'ImageLoad', 'NetworkConnect') THEN image END AS image_path,
    CASE WHEN type = 'ProcessCreate' THEN 'run --n ' || repeat(CAST(k AS STRING), k % 60) END AS command_line,
    CASE WHEN type = 'ProcessCreate' OR type = 'ProcessTerminate' THEN CASE WHEN k % 9 <> 0 THEN CAST(gen AS BIGINT) END END AS create_time,
    CASE WHEN type = 'ImageLoad' THEN 'lib' || CAST(k % 30 AS STRING) || '.dll' END AS image_name,
    CASE WHEN type = 'NetworkConnect' THEN CASE WHEN k % 4 = 0 THEN '10.0.0.' || CAST(k % 8 AS STRING) ELSE '93.184.0.' || CAST(k % 3 AS STRING) END END AS dst_addr,
    CASE WHEN type = 'NetworkConnect' THEN CAST(k % 7 * 100 + 43 AS BIGINT) END AS dst_port,
    CASE WHEN type = 'DnsQuery' THEN CASE WHEN k % 10 = 0 THEN '' ELSE 'h' || CAST(k % 20 AS STRING) || '.example.com' END END AS query_name,
    CASE WHEN type = 'DnsQuery' AND k % 3 = 0 THEN '93.184.1.' || CAST(k % 6 AS STRING) || '; 10.0.0.1' END AS response,
    CASE WHEN type = 'ImageLoad' THEN k % 3 <> 0 END AS signed,
    CASE WHEN type IN ('ProcessCreate', 'ImageLoad') AND k % 2 = 0 THEN 'SHA256=' || CAST(k AS STRING) || 'aa,MD5=' || CAST(k % 7 AS STRING) || 'bb' END AS hashes,
    CASE WHEN type = 'EvasionDetected' AND k % 4 < 3 THEN 'R-' || CAST(k % 4 + 1 AS STRING) END AS rule_id,
    CASE WHEN type = 'EvasionDetected' THEN CASE WHEN k % 3 = 0 THEN 'AmsiBypass' ELSE 'EtwPatching' END END AS technique,
    CASE WHEN type = 'AmsiScan' THEN CAST(k * 400 AS BIGINT) END AS scan_result
  FROM g)
"""


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = "hostlens_events"
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView(view)
    return spark.sql(VIEW.replace("FROM events)", f"FROM {view})") + " SELECT * FROM v")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat view as events: data, rule and process_context are structs; agent_id stays a number."""
    own = {
        "user": F.when(F.col("type") == "ProcessCreate", "user"), "integrity_level": F.when(F.col("type") == "ProcessCreate", "Medium"),
        "protocol": F.when(F.col("type") == "NetworkConnect", "TCP"), "src_addr": F.when(F.col("type") == "NetworkConnect", "10.0.0.9"),
        "src_port": F.when(F.col("type") == "NetworkConnect", 5000), "direction": F.when(F.col("type") == "NetworkConnect", "Outbound"),
        "query_type": F.when(F.col("type") == "DnsQuery", "A"), "script_engine": F.when(F.col("type") == "ScriptBlock", "PowerShell"),
        "content": F.when(F.col("type") == "ScriptBlock", "run"), "app_name": F.when(F.col("type") == "AmsiScan", "PowerShell"),
        "content_name": F.when(F.col("type") == "AmsiScan", "c"), "content_size": F.when(F.col("type") == "AmsiScan", 1),
        "details": F.when(F.col("type") == "EvasionDetected", "patched"), "process_name": F.lit(None),
    }
    rows = flat(spark, sf_dir)
    data = F.struct(*[(own[f.name] if f.name in own else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DATA.fields])
    context = F.when(F.col("process_key").isNotNull(), F.struct(*[(F.col("process_key") if f.name == "process_key" else F.col("context_image") if f.name == "image_path" else F.lit(None)).cast(f.dataType).alias(f.name) for f in CONTEXT.fields]))
    mitre = F.struct(F.lit("Defense Evasion").alias("tactic"), F.concat(F.lit("T100"), F.substring("rule_id", 3, 1)).alias("technique_id"), F.lit("x").alias("technique_name"))
    rule = F.when(F.col("rule_id").isNotNull(), F.struct(F.col("rule_id").alias("id"), F.lit("n").alias("name"), F.lit("d").alias("description"), mitre.alias("mitre"), F.lit("High").alias("confidence"), F.array(F.lit("x")).alias("evidence"))).cast(RULE)
    return rows.select("seq", "id", "event_ts", "agent_id", "category", "severity", "severity_ord", "source_type", "source_detail", data.alias("data"), context.cast(CONTEXT).alias("process_context"), rule.alias("rule"), F.col("k"))
