"""Executable files on disk: what is read of them, and files of other machines, cut off or broken."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from hostlens.operators import pe
from hostlens.plans.fixtures import sample_image
from hostlens.sources import executables


def image32(machine=0x14C, calls=("VirtualAlloc", 7), subsystem=3):
    """A 32-bit file with one section, imports by name and by number, and two exports."""
    body = bytearray(0x600)
    put = lambda at, data: body.__setitem__(slice(at, at + len(data)), data)
    put(0x100, struct.pack("<5I", 0x1000 + 0x180, 0, 0, 0x1000 + 0x160, 0x1000 + 0x180) + bytes(20))
    put(0x160, b"KERNEL32.dll\0")
    at = 0x200
    for i, call in enumerate(calls):
        if isinstance(call, int):
            put(0x180 + 4 * i, struct.pack("<I", 1 << 31 | call))
        else:
            put(0x180 + 4 * i, struct.pack("<I", 0x1000 + at))
            put(at, b"\0\0" + call.encode() + b"\0")
            at += 40
    put(0x300, bytes(24) + struct.pack("<4I", 2, 0, 0x1000 + 0x340, 0))
    put(0x340, struct.pack("<2I", 0x1000 + 0x360, 0x1000 + 0x370))
    put(0x360, b"First\0")
    put(0x370, b"Second\0")
    head = bytearray(0x200)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 0x3C, 0x80)
    optional = struct.pack("<HBBIIIIII", 0x10B, 1, 0, 0, 0, 0, 0x1010, 0x1000, 0x2000) + struct.pack("<IIIHHHHHHIIIIHH", 0x400000, 0x1000, 0x200, 6, 0, 0, 0, 6, 0, 0, 0x5000, 0x200, 0, subsystem, 0) + struct.pack("<6I", 0, 0, 0, 0, 0, 2) + struct.pack("<4I", 0x1000 + 0x300, 40, 0x1000 + 0x100, 40)
    head[0x80:0x98] = b"PE\0\0" + struct.pack("<HHIIIHH", machine, 1, 0, 0, 0, len(optional), 0x102)
    head[0x98 : 0x98 + len(optional)] = optional
    at = 0x98 + len(optional)
    head[at : at + 40] = b".text\0\0\0" + struct.pack("<4I", len(body), 0x1000, len(body), 0x200) + bytes(12) + struct.pack("<I", 0xE0000020)
    return bytes(head) + bytes(body)


@pytest.fixture
def folder(tmp_path):
    files = {"a/i386.exe": image32(), "a/arm.exe": image32(0x1C4), "b/arm64.sys": image32(0xAA64, subsystem=1), "amd64.dll": sample_image(5), "odd.dll": image32(0x9999, (), 77)}
    good = image32()
    files |= {"cut.dll": good[:0x360], "half.dll": good[:0x90], "text.txt": b"hello", "empty": b"", "mz.exe": b"MZ" + bytes(100)}
    broken = bytearray(good)
    struct.pack_into("<I", broken, 0x200 + 0x10C, 0x9000000)  # the library's name is nowhere
    files["broken.dll"] = bytes(broken)
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path, files


def test_files_of_a_folder(spark, folder):
    path, files = folder
    read = executables.read_files(spark, str(path)).cache()
    rows = {os.path.relpath(r.path, path): r for r in pe.headers(read).collect()}
    assert set(rows) == set(files)
    assert {n for n, r in rows.items() if r.valid} == {"a/i386.exe", "a/arm.exe", "b/arm64.sys", "amd64.dll", "odd.dll", "cut.dll", "broken.dll"}
    assert [rows[n].machine for n in ("a/i386.exe", "a/arm.exe", "b/arm64.sys", "amd64.dll", "odd.dll")] == ["PE32 (i386)", "PE32 (ARM)", "PE32+ (ARM64)", "PE32+ (AMD64)", "Unknown"]
    assert [rows[n].subsystem for n in ("a/i386.exe", "b/arm64.sys", "odd.dll")] == ["Windows CUI", "Native", "Other"]
    i386 = rows["a/i386.exe"]
    assert (i386.entry, i386.base, i386.image_size, i386.n_imports, i386.n_exports, i386.bad_imports, i386.bad_exports) == (0x1010, 0x400000, 0x5000, 2, 2, False, False)
    assert rows["broken.dll"].bad_imports and rows["broken.dll"].n_imports == 0 and rows["cut.dll"].bad_exports
    names = [(r.dll, r.name) for r in pe.imports(read).where(F.col("path").endswith("i386.exe")).collect()]
    assert names == [("KERNEL32.dll", "VirtualAlloc"), ("KERNEL32.dll", "#7")]
    assert [r.name for r in pe.exports(read).where(F.col("path").endswith("i386.exe")).collect()] == ["First", "Second"]
    [section] = pe.sections(read).where(F.col("path").endswith("i386.exe")).collect()
    assert section.rights == "RWX" and section.suspicious
    assert {r.category for r in pe.api_summary(read).where(F.col("path").endswith("arm.exe")).collect()} == {"Memory Manipulation"}


def test_the_same_as_from_whole_contents(spark, folder):
    path, files = folder
    whole = pe.parsed(spark.createDataFrame([(n, bytearray(b)) for n, b in files.items()], "path string, content binary"), code=True)
    ranged = executables.read_files(spark, str(path), code=True)
    columns = [c for c in whole.columns if c != "path"]
    want = {r.path: [r[c] for c in columns] for r in whole.collect()}
    assert {os.path.relpath(r.path, path): [r[c] for c in columns] for r in ranged.collect()} == want
    assert pe.stub_findings(ranged).select("stubs").collect() == pe.stub_findings(whole).select("stubs").collect()


def test_what_is_read_of_a_large_file_does_not_grow_with_it(spark, tmp_path):
    data = sample_image(5)
    for name, size in (("small.dll", len(data)), ("large.dll", 60 << 20), ("huge.dll", (64 << 20) + 1)):
        (tmp_path / name).write_bytes(data)
        os.truncate(tmp_path / name, size)
    rows = {os.path.basename(r.path): r for r in executables.read_files(spark, str(tmp_path)).collect()}
    assert rows["large.dll"].bytes_read < 2 << 20 and rows["huge.dll"].bytes_read == rows["large.dll"].bytes_read
    assert [rows[n].too_large for n in ("small.dll", "large.dll", "huge.dll")] == [False, False, True]
    assert all(r.valid and len(r.imports) == 5 and r.code is None for r in rows.values())
    coded = {os.path.basename(r.path): r for r in executables.read_files(spark, str(tmp_path), code=True).collect()}
    assert len(coded["large.dll"].code) == 1 and coded["huge.dll"].code is None


def test_code_is_read_up_to_four_megabytes(spark, tmp_path):
    data = bytearray(sample_image(4))
    at = data.index(b".text") + 8
    struct.pack_into("<I", data, at + 8, 9 << 20)
    (tmp_path / "wide.dll").write_bytes(bytes(data) + b"\x90" * (9 << 20))
    [row] = executables.read_files(spark, str(tmp_path / "wide.dll"), code=True).collect()
    assert [len(x) for x in row.code] == [4 << 20] and row.bytes_read < 5 << 20


def test_no_files_and_no_folder(spark, tmp_path):
    assert executables.read_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        executables.read_files(spark, str(tmp_path / "nowhere")).count()


def test_many_files_make_larger_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(executables, "TASKS", 8, raising=False)
    for i in range(700):
        (tmp_path / f"{i}.dll").write_bytes(b"MZ")
    parts = executables.ExecutablesReader(str(tmp_path), False, []).partitions()
    assert len(parts) == 8 and len({n for p in parts for n, _ in p.names}) == 700


def test_files_with_stubs_are_read_once(spark, tmp_path):
    """Stubs are counted in a file's row: one scan and no exchange, and the counts are those of stub_findings."""
    from hostlens.plans import queries

    (tmp_path / "t").mkdir()
    spark.range(60).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 3 AS user_id", "'purchase' AS event_type", "1.0D AS value", "concat('{\"k\": ', id % 30, '}') AS props").write.parquet(str(tmp_path / "t/events.parquet"))
    rows = queries.pe_files(spark, str(tmp_path / "t"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 1 and "Join" not in plan and "Aggregate" not in plan
    got = {r.name: r.stubs for r in rows.collect()}
    files = pe.parsed(queries._files(spark, str(tmp_path / "t")), code=True)
    want = {r.path.rpartition("\\")[2]: r.stubs for r in pe.stub_findings(files).collect()}
    assert len(got) > 40 and {n: s for n, s in got.items() if s is not None} == want and want
