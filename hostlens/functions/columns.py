"""Scalar functions over events, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ACTING, SEVERITIES, in_source

#: DNS record types by number.
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY"}
#: Signature types by number.
SIGNATURE_TYPES = {0: "None", 1: "Embedded", 2: "Cached", 3: "CatalogCached", 4: "CatalogNotCached", 5: "CatalogHint", 6: "PackageCatalog"}
_V4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(?!$)|$)){4}$"


def event_pid(data: Column) -> Column:
    """The pid of any kind of event; the source's where there are two; null where there is none."""
    return F.coalesce(data["pid"], data["source_pid"])


def acting_pid(data: Column) -> Column:
    return F.when(data["type"].isin(*ACTING), data["pid"])


def effective_key(context: Column, data: Column) -> Column:
    """The process key of the context, else "pid:" and the pid."""
    return F.coalesce(context["process_key"], F.concat(F.lit("pid:"), event_pid(data).cast("string")))


def process_key(pid: Column, create_time: Column) -> Column:
    return F.concat(pid.cast("string"), F.lit(":"), F.coalesce(create_time, F.lit(0)).cast("string"))


def source_type(source: Column) -> Column:
    etw = in_source(source, "$.Etw.provider")
    sysmon = in_source(source, "$.Sysmon.event_id")
    return F.when(etw.isNotNull(), "etw").when(sysmon.isNotNull(), "sysmon").when(source == "EvasionDetector", "evasion").when(source == "Sensor", "sensor")


def source_detail(source: Column) -> Column:
    return F.coalesce(in_source(source, "$.Etw.provider"), in_source(source, "$.Sysmon.event_id"))


def source_label(kind: Column, detail: Column) -> Column:
    return F.when(kind == "etw", F.concat(F.lit("ETW/"), detail)).when(kind == "sysmon", F.concat(F.lit("Sysmon/"), detail)).when(kind == "evasion", "EvasionDetector").otherwise("Sensor")


def severity_ord(severity: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1).cast("int")


def parse_severity(text: str) -> int:
    """The ordinal of a severity's name, case-insensitive, `med` and `crit` too; others are an error."""
    names = {s.lower(): i for i, s in enumerate(SEVERITIES)} | {"med": 2, "crit": 4}
    if text.lower() not in names:
        raise ValueError(f"unknown severity: {text}")
    return names[text.lower()]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most `most` bytes that ends with a character."""
    head = F.substring(text, 1, most)
    fits = F.filter(F.sequence(F.lit(0), F.length(head)), lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= most)
    return F.when(F.octet_length(text) <= most, text).when(F.octet_length(head) <= most, head).otherwise(F.substring(text, F.lit(1), F.array_max(fits)))


def text_contains(raw: Column, needle: str) -> Column:
    """Whether a line holds a text, in any case; escaped backslashes also count as single ones."""
    low, text = F.lower(raw), needle.lower()
    return F.contains(low, F.lit(text)) | F.contains(F.replace(low, F.lit("\\\\"), F.lit("\\")), F.lit(text))


def _let(value: Column, of) -> Column:
    """of(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def is_public_ip(text: Column) -> Column:
    """Whether a text is an address outside the private, loopback, link-local and documentation ranges."""
    return F.coalesce(F.when(text.contains(":"), _let(F.lower(text), _public_v6)).otherwise(text.rlike(_V4) & _let(F.split(text, r"\."), _public_v4)), F.lit(False))


def _public_v4(part: Column) -> Column:
    a, b, c, d = (F.try_element_at(part, F.lit(i + 1)).try_cast("int") for i in range(4))
    inner = (a == 10) | (a == 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    whole = ((a == 255) & (b == 255) & (c == 255) & (d == 255)) | ((a == 0) & (b == 0) & (c == 0) & (d == 0))
    sample = ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    return ~(inner | whole | sample)


def _public_v6(text: Column) -> Column:
    tail = F.substring_index(text, ":", -1)
    octets = [F.try_element_at(F.split(tail, r"\."), F.lit(i + 1)).try_cast("int") for i in range(4)]
    hextets = F.concat(F.hex(octets[0] * 256 + octets[1]), F.lit(":"), F.hex(octets[2] * 256 + octets[3]))
    plain = F.when(tail.rlike(_V4), F.lower(F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), hextets))).otherwise(text)

    def public(t: Column) -> Column:
        full = t.rlike("^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$")
        short = t.rlike("^(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?::(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?$") & (F.regexp_count(t, F.lit("[0-9a-f]+")) <= 7)
        own = t.rlike("^[0:]*(?:(?<=:)0{0,3}1)?$") | t.rlike("^f[cdf][0-9a-f]{2}:") | t.rlike("^fe[89ab][0-9a-f]:") | t.rlike("^2001:0?db8:")
        return (full | short) & ~own

    return _let(plain, public)


def hash_list(hashes: Column) -> Column:
    """The parts of a comma-separated hash field, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(hashes, ","), lambda x: F.trim(x)), lambda x: x != "")


def response_addresses(response: Column) -> Column:
    return F.transform(F.split(response, ";"), lambda x: F.trim(x))


def amsi_result(value: Column) -> Column:
    return F.when(value == 0, "AMSI_RESULT_CLEAN").when(value >= 32768, "AMSI_RESULT_DETECTED").when(value.between(16384, 20479), "AMSI_RESULT_BLOCKED_BY_ADMIN").otherwise("AMSI_RESULT_NOT_DETECTED")


def _named(value: Column, names: dict[int, str], prefix: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(known, value.cast("int")), F.concat(F.lit(prefix), value.cast("string")))


def dns_type(value: Column) -> Column:
    return _named(value, DNS_TYPES, "TYPE")


def signature_type(value: Column) -> Column:
    return _named(value, SIGNATURE_TYPES, "Type")


def registry_key(base: Column, relative: Column) -> Column:
    return F.concat_ws("\\", F.nullif(base, F.lit("")), F.nullif(relative, F.lit("")))


def corrupt_image(image: Column) -> Column:
    """A path of one or two characters, or of control characters and blanks only; an empty one is not corrupt."""
    return (image != "") & ((F.length(image) < 3) | image.rlike(r"^[\p{Cntrl}\s]+$"))


def chosen_layout(declared: Column, other: Column) -> Column:
    """The declared layout's image unless it is corrupt and the other's is not."""
    return F.when(corrupt_image(declared) & ~corrupt_image(other) & (other != ""), other).otherwise(declared)


def rwx(flags: Column) -> Column:
    """Read, write and execute of a section's flags."""
    bit = lambda mask, letter: F.when(flags.bitwiseAND(F.lit(mask)) != 0, letter).otherwise("-")
    return F.concat(bit(0x40000000, "R"), bit(0x80000000, "W"), bit(0x20000000, "X"))


def event_summary(d: Column) -> Column:
    """One line of an event's data."""
    pid = d["pid"].cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    result = F.coalesce(F.nullif(d["scan_result_name"], F.lit("")), F.lit("unknown"))
    kinds = {
        "ProcessCreate": text("ProcessCreate     pid:", pid, " ", d["image_path"], " ", truncate_bytes(d["command_line"], 80)),
        "ProcessTerminate": text("ProcessTerminate  pid:", pid, " ", d["image_path"]),
        "FileCreate": text("FileCreate        pid:", pid, " ", d["operation"], " ", d["path"]),
        "FileDelete": text("FileDelete        pid:", pid, " ", d["path"]),
        "NetworkConnect": text("NetworkConnect    pid:", pid, " ", d["protocol"], " -> ", d["dst_addr"], ":", d["dst_port"].cast("string")),
        "RegistryEvent": text("RegistryEvent     pid:", pid, " ", d["operation"], " ", truncate_bytes(d["key"], 60)),
        "ImageLoad": text("ImageLoad         pid:", pid, " ", d["image_name"], " (", F.when(d["signed"], "signed").otherwise("unsigned"), ")"),
        "DnsQuery": text("DnsQuery          pid:", pid, " ", d["query_name"], " (", d["query_type"], ")"),
        "ScriptBlock": text("ScriptBlock       pid:", pid, " ", d["script_engine"], F.coalesce(F.concat(F.lit(" "), d["script_path"]), F.lit(""))),
        "AmsiScan": text("AmsiScan          pid:", pid, " ", d["app_name"], " [", result, "] ", d["content_name"]),
        "EvasionDetected": text("EvasionDetected   ", F.coalesce(F.concat(F.lit("pid:"), pid, F.lit(" ")), F.lit("")), d["technique"], " ", truncate_bytes(d["details"], 60)),
        "CreateRemoteThread": text("CreateRemoteThread ", d["source_pid"].cast("string"), " -> ", d["target_pid"].cast("string")),
        "ProcessAccess": text("ProcessAccess     ", d["source_pid"].cast("string"), " -> ", d["target_pid"].cast("string"), " (0x", F.hex(d["granted_access"]), ")"),
        "PipeEvent": text("PipeEvent         pid:", pid, " ", d["operation"], " ", d["pipe_name"]),
        "SensorHealth": text("SensorHealth      uptime:", d["uptime_secs"].cast("string"), "s events:", d["events_total"].cast("string")),
    }
    out = F.lit(None).cast("string")
    for kind, line in kinds.items():
        out = F.when(d["type"] == kind, line).otherwise(out)
    return out


def is_script(data: Column) -> Column:
    return data["type"].isin("ScriptBlock", "AmsiScan")


def is_script_related(data: Column) -> Column:
    return is_script(data) | ((data["type"] == "EvasionDetected") & (data["technique"] == "AmsiBypass"))
