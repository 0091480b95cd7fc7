"""The event table: schema, fixed values, and which parsed lines are events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ("Info", "Low", "Medium", "High", "Critical")
CATEGORIES = ("Process", "File", "Network", "Registry", "ImageLoad", "Dns", "Script", "Evasion", "Health")
TECHNIQUES = ("EtwPatching", "AmsiBypass", "NtdllUnhooking", "DirectSyscall", "ProcessHollowing", "ProcessHerpaderping", "DllSearchOrderHijack", "ParentPidSpoofing", "Unknown")

#: Fields that each kind of event must have, beside those that it may have.
REQUIRED = {
    "ProcessCreate": ("pid", "ppid", "image_path", "command_line", "user", "integrity_level"),
    "ProcessTerminate": ("pid", "image_path"),
    "FileCreate": ("pid", "path", "operation"),
    "FileDelete": ("pid", "path"),
    "NetworkConnect": ("pid", "image_path", "protocol", "src_addr", "src_port", "dst_addr", "dst_port", "direction"),
    "RegistryEvent": ("pid", "operation", "key"),
    "ImageLoad": ("pid", "image_path", "image_name", "signed"),
    "DnsQuery": ("pid", "query_name", "query_type"),
    "ScriptBlock": ("pid", "script_engine", "content"),
    "AmsiScan": ("pid", "app_name", "content_name", "content_size", "scan_result"),
    "EvasionDetected": ("technique", "details"),
    "CreateRemoteThread": ("source_pid", "target_pid", "start_address", "source_image", "target_image"),
    "ProcessAccess": ("source_pid", "target_pid", "granted_access", "source_image", "target_image"),
    "PipeEvent": ("pid", "pipe_name", "operation", "image_path"),
    "SensorHealth": ("uptime_secs", "events_total", "events_dropped", "collectors"),
}
OPERATIONS = {
    "FileCreate": ("Create", "Modify", "Rename", "SetInfo", "StreamCreate"),
    "RegistryEvent": ("CreateKey", "DeleteKey", "SetValue", "DeleteValue", "RenameKey"),
    "PipeEvent": ("Created", "Connected"),
}
#: Sources that are a word; others are objects.
SOURCE_WORDS = ("EvasionDetector", "Sensor")
_LONGS = ("pid", "ppid", "create_time", "content_size", "scan_result", "source_pid", "target_pid", "granted_access", "uptime_secs", "events_total", "events_dropped")
_STRINGS = ("type", "image_path", "command_line", "user", "integrity_level", "hashes", "path", "operation", "protocol", "src_addr", "dst_addr", "direction", "key", "value_name", "value_data", "image_name", "signature", "query_name", "query_type", "response", "script_engine", "content", "script_path", "script_block_id", "app_name", "content_name", "scan_result_name", "technique", "process_name", "details", "start_address", "source_image", "target_image", "pipe_name")
#: Kinds whose pid acts; creations and ends of a process, and events of two processes, have none.
ACTING = ("FileCreate", "FileDelete", "NetworkConnect", "RegistryEvent", "ImageLoad", "DnsQuery", "ScriptBlock", "AmsiScan", "EvasionDetected", "PipeEvent")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L = T.StringType(), T.LongType()
CONTEXT = _struct(process_key=_S, image_path=_S, command_line=_S, user=_S, integrity_level=_S, ppid=_L)
RULE = _struct(id=_S, name=_S, description=_S, mitre=_struct(tactic=_S, technique_id=_S, technique_name=_S), confidence=_S, evidence=T.ArrayType(_S))
SINK = _struct(sink_type=_S, events_dropped=_L, spool_files=_L, spool_bytes=_L)
DATA = T.StructType([T.StructField(n, _S) for n in _STRINGS] + [T.StructField(n, _L) for n in _LONGS] + [T.StructField("src_port", _L), T.StructField("dst_port", _L), T.StructField("signed", T.BooleanType()), T.StructField("collectors", T.ArrayType(_struct(name=_S, state=_S))), T.StructField("sink", SINK)])
#: A line of an event file; `source` is an object or a word, so it is read as text.
LINE = _struct(id=_S, timestamp=_S, hostname=_S, agent_id=_S, sensor_version=_S, source=_S, category=_S, severity=_S, data=DATA, rule=RULE, process_context=CONTEXT)

_UUID = r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"
_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def in_source(source: Column, path: str) -> Column:
    """What a source has at a path; a word, which is no JSON, is not parsed."""
    return F.when(~source.isin(*SOURCE_WORDS), F.get_json_object(source, path))


def is_event(e: Column) -> Column:
    """Whether a parsed line (struct LINE) is an event: required fields, known words, numbers in range.

    The numbers are tested by a function over an array. Spark compiles a filter with such a function outside of
    whole-stage code, in methods of a size that the JVM compiles; all tests in one method are too many for that.
    """
    d = e["data"]
    kinds = []
    for kind, fields in REQUIRED.items():
        tests = [d["type"] == kind, *[d[f].isNotNull() for f in fields]]
        if kind in OPERATIONS:
            tests.append(d["operation"].isin(*OPERATIONS[kind]))
        if kind == "NetworkConnect":
            tests += [d["direction"].isin("Outbound", "Inbound"), d["src_port"].between(0, 65535), d["dst_port"].between(0, 65535)]
        if kind == "EvasionDetected":
            tests.append(d["technique"].isin(*TECHNIQUES))
        kinds.append(_all(tests))
    u32 = ("pid", "ppid", "content_size", "scan_result", "source_pid", "target_pid", "granted_access")
    source = e["source"].isin(*SOURCE_WORDS) | in_source(e["source"], "$.Etw.provider").isNotNull() | in_source(e["source"], "$.Sysmon.event_id").cast("int").between(0, 65535)
    rule = e["rule"].isNull() | _all([e["rule"][f].isNotNull() for f in ("id", "name", "description", "mitre", "evidence")] + [e["rule"]["confidence"].isin("Low", "Medium", "High")])
    context = e["process_context"].isNull() | e["process_context"]["process_key"].isNotNull()
    head = [e["id"].rlike(_UUID), e["timestamp"].rlike(_TIME), F.try_to_timestamp(e["timestamp"]).isNotNull(), e["hostname"].isNotNull(), e["agent_id"].rlike(_UUID), e["sensor_version"].isNotNull(), e["category"].isin(*CATEGORIES), e["severity"].isin(*SEVERITIES)]
    ranges = [F.forall(F.array(*[d[f] for f in u32]), lambda n: n.isNull() | n.between(0, 4294967295))]
    return F.coalesce(_all([*head, F.coalesce(source, F.lit(False)), reduce(lambda a, b: a | b, [F.coalesce(k, F.lit(False)) for k in kinds]), rule, context, *ranges]), F.lit(False))
