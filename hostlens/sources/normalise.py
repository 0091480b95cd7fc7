"""Raw records into events: Sysmon XML, and decoded provider records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import DATA

_XML = "struct<System:struct<EventID:string>,EventData:struct<Data:array<struct<_Name:string,_VALUE:string>>>>"
#: Rules of process tampering by its type, and the rest.
TAMPERING = {
    "Image is replaced": ("TF-SYS-001a", "T1055.012", "ProcessHollowing"),
    "Image is locked for access": ("TF-SYS-001b", "T1055", "ProcessHerpaderping"),
    "": ("TF-SYS-001", "T1055", "Unknown"),
}
#: Rules and names of the threat-intelligence provider's events, 0 for any other.
TI_RULES = {
    1: ("TF-TI-001", "Remote Virtual Memory Allocation", "T1055"),
    2: ("TF-TI-002", "Remote Memory Protection Change", "T1055"),
    3: ("TF-TI-003", "Remote Section Mapping", "T1055"),
    4: ("TF-TI-004", "Remote APC Queue", "T1055.004"),
    5: ("TF-TI-005", "Remote Thread Context Modification", "T1055.003"),
    6: ("TF-TI-006", "Local Virtual Memory Allocation (TI)", "T1055"),
    7: ("TF-TI-007", "Local Memory Protection Change (TI)", "T1027.002"),
    8: ("TF-TI-008", "Local Section Mapping (TI)", "T1055"),
    9: ("TF-TI-009", "Remote Thread Suspension", "T1055"),
    10: ("TF-TI-010", "Remote Thread Resume", "T1055"),
    0: ("TF-TI-000", "Threat Intelligence ETW Event", "N/A"),
}
#: The system call behind a threat-intelligence event.
TI_CALLS = {1: "NtAllocateVirtualMemory", 6: "NtAllocateVirtualMemory", 2: "NtProtectVirtualMemory", 7: "NtProtectVirtualMemory", 3: "NtMapViewOfSection", 8: "NtMapViewOfSection", 4: "NtQueueApcThread", 5: "NtSetContextThread", 9: "NtSuspendThread", 10: "NtResumeThread"}
PROVIDER = "Microsoft-Windows-"
#: Providers by the first part of their GUID.
PROVIDER_GUIDS = {
    "22fb2cd6": "Microsoft-Windows-Kernel-Process",
    "edd08927": "Microsoft-Windows-Kernel-File",
    "7dd42a49": "Microsoft-Windows-Kernel-Network",
    "70eb4f03": "Microsoft-Windows-Kernel-Registry",
    "1c95126e": "Microsoft-Windows-DNS-Client",
    "a0c1853b": "Microsoft-Windows-PowerShell",
    "2a576b87": "Microsoft-Antimalware-Scan-Interface",
    "f4e1897c": "Microsoft-Windows-Threat-Intelligence",
}


def provider_name(guid: Column) -> Column:
    """The provider of a GUID, with or without braces, in any case."""
    names = F.create_map(*[F.lit(x) for pair in PROVIDER_GUIDS.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(F.substring(F.ltrim(guid, F.lit("{")), 1, 8))), F.lit("Unknown"))


def parsed_sysmon(records: DataFrame, xml: str = "xml") -> DataFrame:
    """records with eid (null unless a number) and fields (name, value) of their Sysmon XML, empty values left out.

    The parsed record comes out of a generator of one row, past which the optimiser copies no expression, so
    that a record is parsed once and not once a field.
    """
    rows = records.withColumn("x", F.explode(F.array(F.from_xml(F.col(xml), _XML))))
    fields = F.filter(F.coalesce("x.EventData.Data", F.array().cast("array<struct<_Name:string,_VALUE:string>>")), lambda d: d["_VALUE"].isNotNull() & (d["_VALUE"] != "") & d["_Name"].isNotNull())
    return rows.withColumn("eid", F.col("x.System.EventID").try_cast("int")).withColumn("fields", F.transform(fields, lambda d: F.struct(d["_Name"].alias("name"), d["_VALUE"].alias("value")))).drop("x")


class _Fields:
    """Named fields of a record, each taken out of `fields` once, as a column of its own."""

    def __init__(self) -> None:
        self.names: dict[str, str] = {}

    def field(self, name: str) -> Column:
        return F.col(self.names.setdefault(name, f"f_{name}"))

    def text(self, name: str) -> Column:
        return F.coalesce(self.field(name), F.lit(""))

    def _number(self, name: str, most: int) -> Column:
        value = self.field(name).try_cast("long")
        return F.when(value.between(0, most), value).otherwise(F.lit(0))

    def u32(self, name: str) -> Column:
        return self._number(name, 4294967295)

    def u16(self, name: str) -> Column:
        return self._number(name, 65535)

    def hex(self, name: str) -> Column:
        digits = F.regexp_replace(self.text(name), "^0[xX]", "")
        return F.when(digits.rlike("^[0-9a-fA-F]{1,8}$"), F.conv(digits, 16, 10).cast("long")).otherwise(F.lit(0))

    def true(self, name: str) -> Column:
        return F.lower(self.text(name)) == "true"

    def spread(self, rows: DataFrame) -> DataFrame:
        """rows with each named field (of several the last); they too come out of generators of one row, so that each is looked up once."""
        both = F.struct(F.reverse("fields.name").alias("_names"), F.reverse("fields.value").alias("_values"))
        found = [F.try_element_at("_values", F.nullif(F.array_position("_names", n), F.lit(0)).cast("int")).alias(c) for n, c in self.names.items()]
        return rows.select("*", F.inline(F.array(both))).select("*", F.inline(F.array(F.struct(*found)))).drop("_names", "_values")


def _data(kind: str, **fields: Column) -> dict[str, Column]:
    return {"type": F.lit(kind)} | fields


def _chosen(cases: list[tuple[Column, tuple]], rows: DataFrame) -> DataFrame:
    """rows of the first case that holds, with category, severity, data, rule_id and technique_id; others are dropped.

    Each field of data looks only at the cases that set it.
    """
    number = F.lit(None).cast("int")
    for i in reversed(range(len(cases))):
        number = F.when(cases[i][0], i).otherwise(number)
    rows = rows.withColumn("case", number).where("case IS NOT NULL")

    def of(values: list) -> Column:
        out = None
        for i, v in enumerate(values):
            if v is not None:
                v = F.lit(v) if isinstance(v, str) else v
                out = F.when(F.col("case") == i, v) if out is None else out.when(F.col("case") == i, v)
        return F.lit(None) if out is None else out

    told = [c[1] for c in cases]
    data = F.struct(*[of([t[2].get(x.name) for t in told]).cast(x.dataType).alias(x.name) for x in DATA.fields])
    return rows.select("*", of([t[0] for t in told]).alias("category"), of([t[1] for t in told]).alias("severity"), data.alias("data"), of([t[3] for t in told]).cast("string").alias("rule_id"), of([t[4] for t in told]).cast("string").alias("technique_id")).drop("case")


def sysmon_events(records: DataFrame, xml: str = "xml") -> DataFrame:
    """Sysmon records as events (category, severity, data, rule_id, technique_id); other event ids are dropped."""
    f = _Fields()
    pid, image = f.u32("ProcessId"), f.text("Image")
    loaded = f.text("ImageLoaded")
    e = F.col("eid")

    def load(pid_: Column) -> dict[str, Column]:
        return _data("ImageLoad", pid=pid_, image_path=loaded, image_name=F.element_at(F.split(loaded, r"\\"), -1), signed=f.true("Signed"), signature=f.field("Signature"), hashes=f.field("Hashes"))

    two = {"source_pid": f.u32("SourceProcessId"), "target_pid": f.u32("TargetProcessId"), "source_image": f.text("SourceImage"), "target_image": f.text("TargetImage")}
    file = {"pid": pid, "path": f.text("TargetFilename")}
    tampering = F.when(f.text("Type").isin(*[k for k in TAMPERING if k]), f.text("Type")).otherwise("")
    told = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in TAMPERING.items() for x in (k, v[i])]), tampering)
    none = (None, None)
    cases = [
        (e == 1, ("Process", "Info", _data("ProcessCreate", pid=pid, ppid=f.u32("ParentProcessId"), image_path=image, command_line=f.text("CommandLine"), user=f.text("User"), integrity_level=f.text("IntegrityLevel"), hashes=f.field("Hashes")), *none)),
        (e == 3, ("Network", "Info", _data("NetworkConnect", pid=pid, image_path=image, protocol=f.text("Protocol"), src_addr=f.text("SourceIp"), src_port=f.u16("SourcePort"), dst_addr=f.text("DestinationIp"), dst_port=f.u16("DestinationPort"), direction=F.when(f.true("Initiated"), "Outbound").otherwise("Inbound")), *none)),
        (e == 5, ("Process", "Info", _data("ProcessTerminate", pid=pid, image_path=image), *none)),
        (e == 6, ("ImageLoad", "Info", load(F.lit(0)), *none)),
        (e == 7, ("ImageLoad", "Info", load(pid), *none)),
        (e == 8, ("Process", "High", _data("CreateRemoteThread", start_address=f.text("StartAddress"), **two), *none)),
        (e == 10, ("Process", "Medium", _data("ProcessAccess", granted_access=f.hex("GrantedAccess"), **two), *none)),
        (e == 11, ("File", "Info", _data("FileCreate", operation=F.lit("Create"), **file), *none)),
        (e.isin(12, 13, 14), ("Registry", "Info", _data("RegistryEvent", pid=pid, operation=F.when(e == 12, "CreateKey").when(e == 13, "SetValue").otherwise("RenameKey"), key=f.text("TargetObject"), value_data=F.when(e == 13, f.field("Details"))), *none)),
        (e == 15, ("File", "Medium", _data("FileCreate", operation=F.lit("StreamCreate"), **file), *none)),
        (e.isin(17, 18), ("Process", "Info", _data("PipeEvent", pid=pid, pipe_name=f.text("PipeName"), operation=F.when(e == 17, "Created").otherwise("Connected"), image_path=image), *none)),
        (e == 22, ("Dns", "Info", _data("DnsQuery", pid=pid, query_name=f.text("QueryName"), query_type=f.text("QueryType"), response=f.field("QueryResults")), *none)),
        (e.isin(23, 26), ("File", "Info", _data("FileDelete", **file), *none)),
        (e == 25, ("Evasion", "Critical", _data("EvasionDetected", technique=told(2), pid=pid, process_name=f.field("Image"), details=F.concat(F.lit("Sysmon ProcessTampering: "), f.text("Type"))), told(0), told(1))),
    ]
    return _chosen(cases, f.spread(parsed_sysmon(records, xml))).drop("fields", xml, *f.names.values())


def provider_events(records: DataFrame) -> DataFrame:
    """Decoded records (provider, event_id, pid, fields: array of name and value) as events; unknown ones are dropped."""
    f = _Fields()
    p, e = F.col("provider"), F.col("event_id")
    is_ = lambda name: p == PROVIDER + name
    own = F.col("pid").cast("long")
    pid = F.coalesce(F.nullif(f.u32("ProcessID"), F.lit(0).cast("long")), own)
    address = {"pid": f.u32("PID"), "image_path": F.lit(""), "src_addr": f.text("saddr"), "src_port": f.u16("sport"), "dst_addr": f.text("daddr"), "dst_port": f.u16("dport"), "direction": F.when(e.isin(10, 11, 15, 16), "Outbound").otherwise("Inbound")}
    protocol = F.when(e.isin(10, 12), "TCP").when(e.isin(11, 13), "TCPv6").when(e.isin(15, 17), "UDP").otherwise("UDPv6")
    level = f.u32("SignatureLevel")
    signed = level >= 4
    operation = F.when(e == 4, "RenameKey").when(e.isin(1, 2), "CreateKey").when(e == 3, "DeleteKey").when(e == 5, "SetValue").otherwise("DeleteValue")
    scan = f.u32("scanResult")
    known = F.when(e.between(1, 10), e).otherwise(F.lit(0))
    ti = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in TI_RULES.items() for x in (k, v[i])]), known)
    target = f.u32("TargetProcessId")
    remote = e.isin(1, 2, 3, 4, 5, 9, 10)
    ti_text = F.concat(ti(1), F.lit(": PID "), own.cast("string"), F.when(remote & (target > 0), F.concat(F.lit(" → PID "), target.cast("string"))).otherwise(""))
    none = (None, None)
    cases = [
        (is_("Kernel-Process") & (e == 1), ("Process", "Info", _data("ProcessCreate", pid=pid, ppid=f.u32("ParentProcessID"), image_path=f.text("ImageName"), command_line=f.text("CommandLine"), user=F.lit(""), integrity_level=F.lit(""), create_time=f.field("CreateTime").try_cast("long")), *none)),
        (is_("Kernel-Process") & (e == 2), ("Process", "Info", _data("ProcessTerminate", pid=pid, image_path=f.text("ImageName"), create_time=f.field("CreateTime").try_cast("long")), *none)),
        (is_("Kernel-Process") & (e == 5), ("ImageLoad", "Info", _data("ImageLoad", pid=pid, image_path=f.text("ImageName"), image_name=C.basename(f.text("ImageName")), signed=signed, signature=F.when(signed, C.signature_type(f.u32("SignatureType")))), *none)),
        (is_("Kernel-File") & (e == 11), ("File", "Info", _data("FileDelete", pid=own, path=f.text("FileName")), *none)),
        (is_("Kernel-File") & e.isin(10, 12, 13, 14), ("File", "Info", _data("FileCreate", pid=own, path=f.text("FileName"), operation=F.when(e == 13, "SetInfo").when(e == 14, "Rename").otherwise("Create")), *none)),
        (is_("Kernel-Network") & e.isin(10, 11, 12, 13, 15, 16, 17, 18), ("Network", "Info", _data("NetworkConnect", protocol=protocol, **address), *none)),
        (is_("Kernel-Registry") & e.between(1, 6), ("Registry", "Info", _data("RegistryEvent", pid=own, operation=operation, key=C.registry_key(f.text("BaseName"), f.text("RelativeName")), value_name=F.when(e == 4, f.field("NewName")).otherwise(f.field("ValueName")), value_data=F.when(e == 5, f.field("CapturedData"))), *none)),
        (is_("DNS-Client") & e.isin(3006, 3008), ("Dns", "Info", _data("DnsQuery", pid=own, query_name=f.text("QueryName"), query_type=C.dns_type(f.u16("QueryType")), response=F.when((e == 3008) & (f.u32("QueryStatus") == 0), f.field("QueryResults"))), *none)),
        (is_("PowerShell") & (e == 4104), ("Script", "Medium", _data("ScriptBlock", pid=own, script_engine=F.lit("PowerShell"), content=f.text("ScriptBlockText"), script_path=f.field("Path"), script_block_id=f.field("ScriptBlockId")), *none)),
        ((p == "Microsoft-Antimalware-Scan-Interface") & (e == 1101), ("Script", F.when(scan >= 32768, "High").otherwise("Info"), _data("AmsiScan", pid=own, app_name=f.text("appname"), content_name=f.text("contentname"), content_size=f.u32("contentsize"), scan_result=scan, scan_result_name=C.amsi_result(scan)), *none)),
        (is_("Threat-Intelligence"), ("Evasion", F.when(e.isin(6, 7, 8), "Medium").otherwise("High"), _data("EvasionDetected", technique=F.lit("Unknown"), pid=own, details=ti_text), F.when(~e.isin(6, 7, 8), ti(0)), F.when(~e.isin(6, 7, 8), ti(2)))),
    ]
    return _chosen(cases, f.spread(records)).drop("fields", *f.names.values())
