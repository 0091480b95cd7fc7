"""Inputs that the given tables have no rows of, built from them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from ..sources.telemetry import flat


def sample_image(k: int) -> bytes:
    """A small PE file that differs by k: rights of its section, imports, exports, stubs; every eleventh is broken."""
    if k % 11 == 10:
        return b"MZ" + bytes(k % 90)
    calls = ["VirtualAllocEx", "CreateFileW", "GetProcAddress", "NtCreateSection", "WinExec"][: k % 6]
    body = bytearray(1024)
    put = lambda at, data: body.__setitem__(slice(at, at + len(data)), data)
    name_at, lookup = 700, 500
    if calls:
        put(400, struct.pack("<5I", 0x1000 + lookup, 0, 0, 0x1000 + 680, 0x1000 + lookup))
        put(680, b"ntdll.dll\0")
        for i, call in enumerate(calls):
            put(lookup + 8 * i, struct.pack("<Q", 0x1000 + name_at))
            put(name_at, b"\0\0" + call.encode() + b"\0")
            name_at += len(call) + 4
    stub = b"\x4c\x8b\xd1\xb8" + struct.pack("<I", k) + (b"\x0f\x05\xc3" if k % 2 else b"\xff\x25\1\2\3\4")
    put(16, stub * (k % 3))
    if k % 4 == 1:
        put(200, bytes(24) + struct.pack("<4I", 1, 0, 0x1000 + 250, 0))
        put(250, struct.pack("<I", 0x1000 + 260) + bytes(6) + f"Run{k}".encode() + b"\0")
    flags = 0x60000020 | (0x80000000 if k % 5 == 0 else 0)
    head = bytearray(512)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 0x3C, 0x40)
    optional = struct.pack("<HBBIIIII", 0x20B, 1, 0, 0, 0, 0, 0x1000, 0x1000) + struct.pack("<QIIHHHHHHIIIIHH", 0x140000000, 0x1000, 0x200, 6, 0, 0, 0, 6, 0, 0, 0x3000 + k, 0x200, 0, 2 + k % 2, 0) + struct.pack("<4QII", 0, 0, 0, 0, 0, 2) + struct.pack("<4I", 0x1000 + 200 if k % 4 == 1 else 0, 40, 0x1000 + 400 if calls else 0, 40)
    head[0x40 : 0x40 + 24] = b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, len(optional), 0x22)
    head[0x58 : 0x58 + len(optional)] = optional
    at = 0x58 + len(optional)
    head[at : at + 40] = b".text\0\0\0" + struct.pack("<4I", 1024, 0x1000, 1024, 512) + bytes(12) + struct.pack("<I", flags)
    return bytes(head) + bytes(body)


def files_on_disk(images: DataFrame, folder: str) -> str:
    """Writes images (path, content) as files of a folder, by tasks, and gives the folder."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                with system.open_output_stream(f"{root}/" + path.rpartition("\\")[2]) as file:
                    file.write(content)
            yield frame[["path"]]

    images.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return folder


def sysmon_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of Sysmon XML, made from the telemetry."""
    d = lambda name, value: F.concat(F.lit(f'<Data Name="{name}">'), F.coalesce(value.cast("string"), F.lit("")), F.lit("</Data>"))
    c = F.col
    rows = flat(spark, sf_dir)
    eid = F.expr("CASE type WHEN 'ProcessCreate' THEN 1 WHEN 'ProcessTerminate' THEN 5 WHEN 'NetworkConnect' THEN 3 WHEN 'ImageLoad' THEN 7 WHEN 'DnsQuery' THEN 22 WHEN 'EvasionDetected' THEN 25 WHEN 'ScriptBlock' THEN 10 ELSE 99 END")
    kind = F.expr("CASE k % 3 WHEN 0 THEN 'Image is replaced' WHEN 1 THEN 'Image is locked for access' ELSE 'Other &amp; more' END")
    fields = F.concat(d("ProcessId", c("pid")), d("ParentProcessId", c("ppid")), d("Image", c("image_path")), d("CommandLine", c("command_line")), d("DestinationIp", c("dst_addr")), d("DestinationPort", c("dst_port")), d("Initiated", F.expr("CASE WHEN k % 2 = 0 THEN 'True' ELSE 'false' END")), d("ImageLoaded", F.when(c("type") == "ImageLoad", F.concat(F.lit("C:\\lib\\"), c("image_name")))), d("Signed", c("signed")), d("QueryName", c("query_name")), d("QueryType", F.lit("1")), d("QueryResults", c("response")), d("Type", kind), d("SourceProcessId", c("pid")), d("TargetProcessId", c("pid") + 1), d("GrantedAccess", F.concat(F.lit("0x"), F.hex(c("k") * 16))), F.lit('<Data Name="Empty"/>'))
    xml = F.concat(F.lit("<Event><System><EventID>"), eid.cast("string"), F.lit("</EventID></System><EventData>"), fields, F.lit("</EventData></Event>"))
    return written(rows.select("seq", xml.alias("xml")).repartition(spark.sparkContext.defaultParallelism), "sysmon")


def provider_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of decoded provider records, made from the telemetry."""
    f = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    c = F.col
    rows = flat(spark, sf_dir)
    provider = F.expr("CASE type WHEN 'NetworkConnect' THEN 'Microsoft-Windows-Kernel-Network' WHEN 'DnsQuery' THEN 'Microsoft-Windows-DNS-Client' WHEN 'EvasionDetected' THEN 'Microsoft-Windows-Threat-Intelligence' WHEN 'AmsiScan' THEN 'Microsoft-Antimalware-Scan-Interface' WHEN 'ScriptBlock' THEN 'Microsoft-Windows-PowerShell' ELSE 'Microsoft-Windows-Kernel-Process' END")
    event = F.expr("CASE type WHEN 'NetworkConnect' THEN 10 + k % 9 WHEN 'DnsQuery' THEN CASE WHEN k % 2 = 0 THEN 3006 ELSE 3008 END WHEN 'EvasionDetected' THEN k % 12 WHEN 'AmsiScan' THEN 1101 WHEN 'ScriptBlock' THEN 4104 WHEN 'ProcessCreate' THEN 1 WHEN 'ProcessTerminate' THEN 2 ELSE 5 END")
    fields = F.array(f("PID", c("pid")), f("ProcessID", c("pid")), f("ParentProcessID", c("ppid")), f("ImageName", c("image_path")), f("daddr", c("dst_addr")), f("dport", c("dst_port")), f("QueryName", c("query_name")), f("QueryType", c("k")), f("QueryStatus", c("k") % 3), f("QueryResults", c("response")), f("scanResult", c("scan_result")), f("SignatureLevel", c("k") % 8), f("SignatureType", c("k") % 9), f("TargetProcessId", c("k") % 4))
    return written(rows.repartition(spark.sparkContext.defaultParallelism).select("seq", "pid", provider.alias("provider"), event.alias("event_id"), F.filter(fields, lambda x: x["value"].isNotNull()).alias("fields")), "provider")
