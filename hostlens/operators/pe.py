"""Corpus jobs over executable files, and byte patterns."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of machines and subsystems by number.
MACHINES = {0x14C: "PE32 (i386)", 0x8664: "PE32+ (AMD64)", 0x1C4: "PE32 (ARM)", 0xAA64: "PE32+ (ARM64)"}
SUBSYSTEMS = {0: "Unknown", 1: "Native", 2: "Windows GUI", 3: "Windows CUI", 5: "OS/2 CUI", 7: "POSIX CUI", 8: "Native Windows", 9: "Windows CE GUI", 10: "EFI Application", 11: "EFI Boot Service Driver", 12: "EFI Runtime Driver", 14: "Xbox"}
#: Functions that each category of suspicious calls has.
SUSPICIOUS = {
    "Process Injection": ("VirtualAllocEx", "WriteProcessMemory", "CreateRemoteThread", "CreateRemoteThreadEx", "NtCreateThreadEx", "NtWriteVirtualMemory", "NtMapViewOfSection", "QueueUserAPC", "RtlCreateUserThread"),
    "Code Execution": ("CreateProcessA", "CreateProcessW", "CreateProcessAsUserA", "CreateProcessAsUserW", "ShellExecuteA", "ShellExecuteW", "ShellExecuteExA", "ShellExecuteExW", "WinExec"),
    "Memory Manipulation": ("VirtualProtect", "VirtualProtectEx", "VirtualAlloc", "VirtualAllocEx", "NtAllocateVirtualMemory", "NtProtectVirtualMemory"),
    "Hooking / Dynamic Resolution": ("SetWindowsHookExA", "SetWindowsHookExW", "GetProcAddress", "LoadLibraryA", "LoadLibraryW", "LoadLibraryExA", "LoadLibraryExW", "LdrLoadDll"),
    "Credential Access": ("CredReadA", "CredReadW", "LsaRetrievePrivateData", "CryptUnprotectData"),
    "Defense Evasion": ("NtUnmapViewOfSection", "NtCreateSection", "NtSetContextThread", "NtResumeThread", "NtSuspendThread", "EtwEventWrite"),
}
EXECUTE, CODE = 0x20000000, 0x20
#: Files, and bytes of them, that are made into rows at once.
FILES, PIECE = 256, 8 * 1024 * 1024
BUDGET = 4 * 1024 * 1024
_SCHEMA = "valid boolean, machine int, subsystem int, entry long, base long, image_size long, sections array<struct<name:string,rva:long,vsize:long,raw:long,size:long,flags:long>>, imports array<struct<dll:string,name:string>>, exports array<string>, bad_imports boolean, bad_exports boolean, code array<binary>"


class Image:
    """Reads fields of a file by ranges; None where it ends. `read` gives the bytes from a place on, at most so many."""

    def __init__(self, size: int, read: Callable[[int, int], bytes]) -> None:
        self.size, self.read = size, read
        self.sections: list[tuple] = []

    @classmethod
    def of(cls, data: bytes) -> Image:
        return cls(len(data), lambda at, n: data[at : at + n])

    def at(self, form: str, offset: int):
        size = struct.calcsize(form)
        return struct.unpack(form, self.read(offset, size))[0] if 0 <= offset <= self.size - size else None

    def place(self, rva: int) -> int | None:
        for _, start, vsize, raw, size, _ in self.sections:
            if start <= rva < start + max(vsize, size):
                return raw + rva - start
        return None

    def name(self, offset: int | None, most: int = 512) -> str | None:
        if offset is None or not 0 <= offset < self.size:
            return None
        text, end, _ = self.read(offset, most).partition(b"\0")
        return text.decode("latin-1") if end else None


def parse(f: Image, code: bool = False) -> dict:
    """Header facts, sections, imports and exports of a PE file; valid is False for anything else.

    With `code` the bytes of sections that can be executed come along, 4 MB of them together.
    """
    bad = {"valid": False}
    if f.size < 64 or f.read(0, 2) != b"MZ":
        return bad
    pe = f.at("<I", 0x3C)
    if f.read(pe, 4) != b"PE\0\0" or f.at("<I", pe + 20) is None:
        return bad
    head, optional = pe + 4, pe + 24
    machine, count, width = f.at("<H", head), f.at("<H", head + 2), f.at("<H", head + 16)
    magic = f.at("<H", optional)
    if magic not in (0x10B, 0x20B) or f.at("<H", optional + 68) is None:
        return bad
    wide = magic == 0x20B
    for i in range(count):
        o = optional + width + 40 * i
        if o + 40 > f.size:
            break
        row = f.read(o, 40)
        vsize, rva, size, raw = struct.unpack_from("<4I", row, 8)
        f.sections.append((row[:8].split(b"\0")[0].decode("latin-1"), rva, vsize, raw, size, struct.unpack_from("<I", row, 36)[0]))
    tables = optional + (112 if wide else 96)
    n_tables = f.at("<I", tables - 4) or 0
    export, into = ((f.at("<I", tables + 8 * k) or 0) if k < n_tables else 0 for k in (0, 1))
    imports, exports, bad_imports, bad_exports = [], [], False, False
    if into:
        at, ended = f.place(into), False
        for k in range(4096):
            o = None if at is None else at + 20 * k
            names, dll = (None, None) if o is None else (f.at("<I", o), f.at("<I", o + 12))
            if names is None or dll is None:
                break
            first = f.at("<I", o + 16)
            if dll == 0 and not names and not first:
                ended = True
                break
            library, table = f.name(f.place(dll)), f.place(names or first or 0)
            if library is None or table is None:
                bad_imports = True
                continue
            for i in range(65536):
                entry = f.at("<Q" if wide else "<I", table + i * (8 if wide else 4))
                if not entry:
                    bad_imports |= entry is None
                    break
                by_number = entry >> (63 if wide else 31)
                name = f"#{entry & 0xFFFF}" if by_number else f.name((f.place(entry & 0x7FFFFFFF) or -3) + 2)
                if name is None:
                    bad_imports = True
                else:
                    imports.append({"dll": library, "name": name})
        bad_imports |= not ended
    if export:
        at = f.place(export)
        number, names = (None, None) if at is None else (f.at("<I", at + 24), f.place(f.at("<I", at + 32) or 0))
        if number is None or (number and names is None):
            bad_exports = True
        else:
            for i in range(min(number, 65536)):
                name = f.name(f.place(f.at("<I", names + 4 * i) or 0))
                if name is None:
                    bad_exports = True
                else:
                    exports.append(name)
    parts, room = [], BUDGET
    for _, _, _, raw, size, flags in f.sections if code else []:
        if flags & (EXECUTE | CODE) and room:
            parts.append(f.read(raw, min(size, room)))
            room -= len(parts[-1])
    sections = [dict(zip(("name", "rva", "vsize", "raw", "size", "flags"), s)) for s in f.sections]
    return {"valid": True, "machine": machine, "subsystem": f.at("<H", optional + 68), "entry": f.at("<I", optional + 16), "base": f.at("<Q", optional + 24) if wide else f.at("<I", optional + 28), "image_size": f.at("<I", optional + 56), "sections": sections, "imports": imports, "exports": exports, "bad_imports": bad_imports, "bad_exports": bad_exports, "code": parts if code else None}


def pieces(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Slices of rows with `content` of at most FILES rows, and of about PIECE bytes (one row may have more)."""
    start, size = 0, 0
    for i, x in enumerate(frame["content"]):
        if i > start and (i - start == FILES or size + len(x or b"") > PIECE):
            yield frame.iloc[start:i]
            start, size = i, 0
        size += len(x or b"")
    if start < len(frame):
        yield frame.iloc[start:]


def small_batches() -> None:
    """Lowers the session's bytes an Arrow batch to PIECE, if they are more, as rows hold whole files."""
    spark, key = SparkSession.active(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > PIECE:
        spark.conf.set(key, str(PIECE))


def parsed(files: DataFrame, code: bool = False) -> DataFrame:
    """Rows (path, content) with what parse() tells of each; for files on disk see sources.executables, which reads them by ranges."""
    names = [p.split(" ")[0] for p in _SCHEMA.split(", ") if " " in p]

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for piece in pieces(frame):
                rows = [parse(Image.of(x or b""), code) for x in piece["content"]]
                yield pd.DataFrame({"path": piece["path"], **{n: pd.Series([r.get(n) for r in rows], index=piece.index, dtype=object) for n in names}})

    small_batches()
    return files.mapInPandas(of, f"path string, {_SCHEMA}")


def _name(value: Column, names: dict[int, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), F.lit(other))


def headers(images: DataFrame, *more: Column) -> DataFrame:
    """Facts of each file, with further columns of its row."""
    return images.select("path", "valid", F.when(F.col("valid"), _name(F.col("machine"), MACHINES, "Unknown")).alias("machine"), F.when(F.col("valid"), _name(F.col("subsystem"), SUBSYSTEMS, "Other")).alias("subsystem"), "entry", "base", "image_size", F.size("imports").alias("n_imports"), F.size(F.array_distinct(F.transform("imports", lambda i: F.lower(i["dll"])))).alias("n_dlls"), F.size("exports").alias("n_exports"), "bad_imports", "bad_exports", *more)


def sections(images: DataFrame) -> DataFrame:
    """One row a section, with its rights; suspicious where it can be written and executed."""
    from ..functions.columns import rwx

    s = F.col("s")
    rights = rwx(s["flags"])
    return images.where("valid").select("path", F.explode("sections").alias("s")).select("path", s["name"].alias("section"), s["rva"].alias("rva"), s["vsize"].alias("vsize"), rights.alias("rights"), rights.rlike("WX$").alias("suspicious"))


def imports(images: DataFrame) -> DataFrame:
    return images.where("valid").select("path", F.explode("imports").alias("i")).select("path", "i.dll", "i.name")


def exports(images: DataFrame) -> DataFrame:
    return images.where("valid").select("path", F.explode("exports").alias("name"))


def api_summary(images: DataFrame) -> DataFrame:
    """Suspicious calls of each file by category, with how many files have that category."""
    spark = images.sparkSession
    known = spark.createDataFrame([(category, api) for category, apis in SUSPICIOUS.items() for api in apis], "category string, api string")
    found = imports(images).join(F.broadcast(known), F.col("name") == F.col("api"))
    each = found.groupBy("path", "category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("api")), ",").alias("apis"))
    return each.join(each.groupBy("category").agg(F.count("*").alias("files")), "category").select("path", "category", "n", "apis", "files")


# Byte patterns

_MOV = r"(?:\x4C\x8B\xD1|\x49\x89\xCA)"
_NUMBER = r"(?:[\x00-\xFF][\x00-\x05]|\x00\x06)\x00\x00"
_END = r"(?:\x0F\x05|\xCD\x2E|\xFF\x25[\x00-\xFF]{4}|\x41\xFF[\xE3\xE1])\xC3?"
STUB = rf"(?s)(?:{_MOV}\xB8{_NUMBER}|\xB8{_NUMBER}{_MOV})[\x00-\xFF]{{0,12}}?{_END}"


def stubs(data: Column) -> Column:
    """System-call stubs in bytes, as an array of (at, ssn, indirect): a number up to 0x600 in a prologue, then a call within 12 bytes."""
    text = F.decode(data, "ISO-8859-1")
    found = F.regexp_extract_all(text, F.lit(STUB), F.lit(0))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,ssn:int,indirect:boolean>>").alias("all"))

    def step(s: Column, m: Column) -> Column:
        at = F.locate_from(m, text, s["next"]) if hasattr(F, "locate_from") else F.call_function("locate", m, text, s["next"])
        low = F.when(F.ascii(m) == 0xB8, F.lit(2)).otherwise(F.lit(5))
        number = F.ascii(F.substring(m, low, F.lit(1))) + 256 * F.ascii(F.substring(m, low + 1, F.lit(1)))
        indirect = ~m.rlike(r"(?s)(?:\x0F\x05|\xCD\x2E)\xC3?$")
        one = F.struct((at - 1).alias("at"), number.cast("int").alias("ssn"), indirect.alias("indirect"))
        return F.struct((at + F.length(m)).alias("next"), F.array_append(s["all"], one).alias("all"))

    return F.aggregate(found, start, step, lambda s: s["all"])


def prologue_patch(data: Column) -> Column:
    """What a patched function's first bytes do: (pattern, confidence), null where they look whole."""
    h = F.hex(data)
    forced = F.when(F.startswith(h, F.lit("B857000780")), "E_INVALIDARG").when(F.startswith(h, F.lit("B801000000")), "S_FALSE").otherwise("imm32")
    return F.when(h.rlike("^B8.{8}C3"), F.struct(F.concat(F.lit("mov-ret "), forced).alias("pattern"), F.lit("High").alias("confidence"))).when(h.rlike("^3[13]C0C3"), F.struct(F.lit("xor-ret").alias("pattern"), F.lit("High").alias("confidence"))).when(h.rlike("^C3.."), F.struct(F.lit("ret").alias("pattern"), F.lit("Medium").alias("confidence"))).when(h.rlike("^90C3"), F.struct(F.lit("nop-ret").alias("pattern"), F.lit("Medium").alias("confidence")))


def stub_count(code: Column) -> Column:
    """How many stubs the parts of a file's code have; null where there are none, or no code was read."""
    each = F.transform(code, lambda part: F.regexp_count(F.decode(part, "ISO-8859-1"), F.lit(STUB)).cast("long"))
    n = F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(n > 0, n)


def stub_findings(images: DataFrame) -> DataFrame:
    """Stubs in each file's code, where that was read: (path, stubs, direct, indirect)."""
    rows = images.where("valid").select("path", F.explode("code").alias("part")).select("path", F.explode(stubs(F.col("part"))).alias("stub"))
    return rows.groupBy("path").agg(F.count("*").alias("stubs"), F.count_if(~F.col("stub.indirect")).alias("direct"), F.count_if(F.col("stub.indirect")).alias("indirect"))


def is_system_module(path: Column, root: str = "C:\\Windows") -> Column:
    """ntdll.dll and win32u.dll below the system folders."""
    low = F.lower(path)
    return F.element_at(F.split(low, r"[/\\]"), -1).isin("ntdll.dll", "win32u.dll") & (F.startswith(low, F.lit(root.lower() + "\\system32\\")) | F.startswith(low, F.lit(root.lower() + "\\syswow64\\")))


def loads_with_stubs(loads: DataFrame, findings: DataFrame) -> DataFrame:
    """Image loads of files with stubs: a detection TF-EVA-005 (High) with direct ones, else Info; system modules are exempt."""
    left = loads.where(~is_system_module(F.col("image_path"))).withColumn("file", F.lower("image_path"))
    right = findings.select(F.lower("path").alias("file"), "stubs", "direct")
    return left.join(right, "file").select("seq", "pid", "image_path", "stubs", F.when(F.col("direct") > 0, "High").otherwise("Info").alias("severity"), F.when(F.col("direct") > 0, "TF-EVA-005").alias("rule_id"))


def unimported_calls(calls: DataFrame, modules: DataFrame, imported: DataFrame) -> DataFrame:
    """Calls (agent_id, pid, seq, function) of a process none of whose modules imports the function from ntdll.dll."""
    from_ntdll = imported.where(F.lower("dll") == "ntdll.dll").select(F.lower("path").alias("file"), F.lower("name").alias("low"))
    known = modules.select("agent_id", "pid", F.lower("image_path").alias("file")).distinct().join(from_ntdll, "file").select("agent_id", "pid", "low").distinct()
    rows = calls.withColumn("low", F.lower("function"))
    return rows.join(known, ["agent_id", "pid", "low"], "left_anti").drop("low")


def best_module(candidates: DataFrame) -> DataFrame:
    """Of each process the module with the most stubs, any with direct ones above all others."""
    rank = F.col("stubs") + F.when(F.col("direct") > 0, 1000).otherwise(0)
    return candidates.groupBy("agent_id", "pid").agg(F.max_by(F.struct("image_path", "stubs"), F.struct(rank.alias("r"), F.col("image_path"))).alias("m"), F.max(rank).alias("rank")).select("agent_id", "pid", "m.*", "rank")
