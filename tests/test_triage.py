from __future__ import annotations

import hashlib
import math
import random
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sentrilake.operators import triage


def files(spark, *contents):
    rows = [(f"f{i}", bytearray(c)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "path string, content binary")


def entropy(data):
    return -sum(p * math.log2(p) for p in (data.count(b) / len(data) for b in set(data))) if data else 0.0


def pe(sections, extra=b"", opt=240, magic=0x20B, stub=b""):
    head = bytearray(b"MZ" + bytes(62)) + bytes(0x40) + stub
    struct.pack_into("<I", head, 0x3C, len(head))
    head += b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, len(sections), 7, 0, 0, opt, 0x22)
    options = bytearray(opt)
    struct.pack_into("<H", options, 0, magic)
    struct.pack_into("<I", options, 16, 0x1234)
    head += options
    start = len(head) + 40 * len(sections)
    body = b""
    for name, data, flags in sections:
        head += name.ljust(8, b"\0") + struct.pack("<IIII", len(data), 0x1000, len(data), start + len(body))
        head += bytes(12) + struct.pack("<I", flags)
        body += data
    return bytes(head) + body + extra


def test_entropy(spark):
    rnd = random.Random(1)
    blob = rnd.randbytes(triage.CHUNK * 2 + 77)
    cases = [bytes(1000), bytes(range(256)) * 10, b"", blob]
    got = {r.path: r for r in triage.byte_entropy(files(spark, *cases)).collect()}
    for i, data in enumerate(cases):
        assert abs(got[f"f{i}"].entropy - entropy(data)) < 1e-9
        assert got[f"f{i}"].n_bytes == len(data)
    assert got["f1"].is_packed and not got["f0"].is_packed


def test_pe(spark):
    rnd = random.Random(2)
    dense = rnd.randbytes(20_000)
    stub = b"Rich" + bytes(28)
    data = pe([(b".text", b"abc" * 50, 0x60000020), (b".data", dense, 0xC0000040)], b"D:\\x\\prog.pdb\0", stub=stub)
    head = triage.pe_headers(files(spark, data, b"MZ" + bytes(100))).collect()
    assert len(head) == 1
    assert (head[0].machine_name, head[0].number_of_sections, head[0].entry_point) == ("AMD64 / x86_64", 2, 0x1234)
    assert head[0].debug_pdb_path == "prog.pdb"
    assert head[0].rich_header_hash == hashlib.sha256(stub).hexdigest()
    rows = triage.pe_sections(files(spark, data)).orderBy("section_index").collect()
    assert [r.name for r in rows] == [".text", ".data"]
    assert rows[1].is_writable and not rows[0].is_writable and rows[0].is_executable
    assert abs(rows[1].entropy - entropy(dense)) < 1e-9
    triaged = triage.binary_triage(files(spark, data, b"\x7fELF" + bytes(60), b"abc")).orderBy("path").collect()
    assert [(r.format, r.is_packed) for r in triaged] == [("PE", True), ("ELF", False), ("unknown", False)]


def test_protector(spark):
    data = pe([(b".vmp0", b"", 0x60000020)], bytes(4096))
    assert [r.finding for r in triage.protector_sections(files(spark, data)).collect()] == [".vmp0"]
    assert triage.protector_report(files(spark, data)).first().is_protected


def test_macho_and_big_endian_elf(spark):
    macho = struct.pack("<IIIII", 0xFEEDFACF, 0x01000007, 3, 2, 16) + bytes(12)
    elf = b"\x7fELF\x02\x02\x01\x09" + bytes(8) + struct.pack(">HHIQ", 3, 62, 1, 0x401000) + bytes(40)
    rows = triage.binary_triage(files(spark, macho, elf)).orderBy("path").collect()
    assert (rows[0].format, rows[0].load_commands, rows[0].is_64bit) == ("Mach-O", 16, True)
    assert (rows[1].elf_type, rows[1].machine, int(rows[1].entry_point), rows[1].os_abi) == (3, 62, 0x401000, 9)
    assert rows[1].is_little_endian is False


def test_indicators(spark):
    rows = triage.indicator_strings(files(spark, b"\xff\xfeVirtualAllocEx\0LdrLoadDll", b"none")).collect()
    assert {r.indicator for r in rows} == {"VirtualAllocEx", "LdrLoadDll"}


def test_syscall_stubs(spark):
    direct = bytes.fromhex("4C8BD1B8180000000F05C3")
    gate = bytes.fromhex("6A33E80000000083042405CB")
    jump = bytes.fromhex("90904C8BD1B899000000FFE09090")
    legacy = bytes.fromhex("B855000000CD2E")
    short = bytes.fromhex("4C8BD1B899000000FFE0")
    rows = triage.syscall_stubs(files(spark, direct, gate, jump + legacy, short)).orderBy("path", "offset").collect()
    assert [(r.path, r.offset, r.invocation_type, r.ssn) for r in rows] == [
        ("f0", 0, "DirectSyscall", 0x18), ("f1", 0, "HeavensGate32To64", None),
        ("f2", 2, "IndirectSyscallGadget", 0x99), ("f2", 14, "Int2EGate", 0x55),
        ("f3", 0, "DirectSyscall", 0x99),
    ]
    assert rows[0].api_name == "NtAllocateVirtualMemory"
    assert rows[2].api_name == "NtUnknownSyscall_0x0099"


def test_memory_regions(spark):
    rnd = random.Random(3)
    rows = [
        (1, 0, bytearray(b"MZ" + bytes(4094)), None), (2, 0, bytearray(b"\xfc\x48\x83\xe4\xf0" + bytes(1019)), None),
        (3, 0, bytearray(b"MZ" + bytes(4094) + rnd.randbytes(9000)), "a.dll"),
        (4, 0, bytearray(b"MZ" + bytes(4094) + rnd.randbytes(9000)), "a.exe"),
        (5, 0, bytearray(b"MZ"), None), (6, 0, bytearray(b"\xe8\0\0\0\0\x5d" + bytes(90)), "a.dll"),
    ]
    regions = spark.createDataFrame(rows, "pid long, base_address long, content binary, mapped_file string")
    got = {r.pid: (r.injection_type, r.confidence) for r in triage.memory_region_triage(regions).collect()}
    assert got == {
        1: ("ReflectiveDllInjection", 0.98), 2: ("UnbackedExecutableMemory", 0.95), 3: ("ModuleStomping", 0.92)
    }
    report = {r.pid: r.is_compromised for r in triage.injection_report(regions).collect()}
    assert report == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def scan_stack(code):
    """Plain statement of the stack-string rule, for comparison."""
    found, chars, start, i = [], "", 0, 0
    while i + 4 <= len(code):
        write = code[i : i + 2] == b"\xc6\x45"
        byte = code[i + 3]
        if write and 0x20 <= byte <= 0x7E:
            start = i if not chars else start
            chars += chr(byte)
        else:
            if len(chars) >= 4 and (not write or byte == 0):
                found.append((start, chars))
            chars = ""
        i += 4 if write else 1
    return found


def test_stack_strings(spark):
    rnd = random.Random(4)

    def blob():
        out = b""
        for _ in range(40):
            out += rnd.choice(
                [b"\xc6\x45" + bytes([rnd.randrange(256), rnd.choice(b"abcdef")])] * 6
                + [b"\xc6\x45\x01\x00", b"\xc6\x45\x02\xc6", b"\x90", b"\x45"]
            )
        return out

    plain = b"".join(bytes([0xC6, 0x45, 0xF0, c]) for c in b"test\0")
    cases = [plain, plain[:-4], plain[:-4] + b"\x90", plain[:-4] + b"\x90" * 4] + [blob() for _ in range(30)]
    rows = triage.stack_strings(files(spark, *cases)).collect()
    got = sorted((r.path, r.offset, r.value) for r in rows)
    assert got == sorted((f"f{i}", o, v) for i, c in enumerate(cases) for o, v in scan_stack(c))


def scan_xor(code):
    found = []
    for key in range(1, 256):
        run, start = "", 0
        for i, b in enumerate(code):
            c = b ^ key
            if 0x20 <= c <= 0x7E:
                start = i if not run else start
                run += chr(c)
            else:
                if len(run) >= 7 and any(w in run for w in triage.XOR_WORDS):
                    found.append((start, run, f"XOR Key 0x{key:02X}"))
                run = ""
    return found


def test_xor_strings(spark):
    rnd = random.Random(5)

    def hide(word, key):
        return bytes(b ^ key for b in b"\0" + word + b"\0")

    cases = [
        hide(b"http://evil.test", 0x41) + hide(b"cmd.exe /c", 7), b"plain http text is not hidden",
        bytes(b ^ 0x33 for b in b"\0http://tail"),
        rnd.randbytes(300) + hide(b"kernel32", 0xFF) + rnd.randbytes(300), b"", b"a",
        bytes(rnd.choice(b"abcdilmpt.AP ") for _ in range(3000)),
    ]
    rows = triage.xor_strings(files(spark, *cases)).collect()
    got = sorted((r.path, r.offset, r.value, r.method) for r in rows)
    assert got == sorted((f"f{i}", *hit) for i, c in enumerate(cases) for hit in scan_xor(c))
    assert len(got) >= 3


def parse_sections(data):
    """Plain walk over the section headers; None if the bytes are not a PE file."""
    if len(data) < 64 or data[:2] != b"MZ":
        return None
    at = struct.unpack_from("<I", data, 0x3C)[0]
    if len(data) < at + 24 or data[at : at + 4] != b"PE\0\0":
        return None
    count, opt = struct.unpack_from("<H", data, at + 6)[0], struct.unpack_from("<H", data, at + 20)[0]
    out = []
    for i in range(count):
        head = at + 24 + opt + 40 * i
        if len(data) < head + 40:
            break
        size, start = struct.unpack_from("<II", data, head + 16)
        body = data[start : start + size] if start + size <= len(data) else b""
        out.append((i, size, start, round(entropy(body), 6)))
    return out


def test_damaged_pe_files(spark):
    rnd = random.Random(6)
    good = pe([(b".text", b"abc" * 50, 0x60000020), (b".data", rnd.randbytes(300), 0xC0000040)], bytes(50))
    cases = [good[:n] for n in (0, 1, 63, 64, 100, 130, 160, 200, 400, len(good) - 60)]
    cases.append(b"MZ" + bytes(58) + b"\xff" * 8 + bytes(100))
    cases.append(b"MZ" + bytes(58) + struct.pack("<I", 2**31 - 1) + bytes(100))
    for _ in range(60):
        broken = bytearray(good)
        for _ in range(rnd.randrange(1, 12)):
            broken[rnd.choice([rnd.randrange(len(good)), rnd.randrange(128, 520)])] = rnd.choice([0, 1, 255, rnd.randrange(256)])
        cases.append(bytes(broken))
    table = files(spark, *cases)
    got = {}
    for r in triage.pe_sections(table).collect():
        got.setdefault(r.path, []).append((r.section_index, r.raw_data_size, r.raw_data_ptr, round(r.entropy, 6)))
    want = {f"f{i}": parse_sections(c) for i, c in enumerate(cases)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    kinds = {r.path: r.format for r in triage.binary_triage(table).collect()}
    assert kinds == {k: "PE" if v is not None else "unknown" for k, v in want.items()}
    triage.pe_headers(table).collect()
    triage.pe_data_directories(table).collect()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contents_are_counted_once_and_not_shuffled(spark):
    data = bytes(range(256)) * 1024  # eight chunks
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray())], "path string, content binary")
    found = {r.path: r for r in triage.byte_entropy(files).collect()}
    assert found["a"].n_bytes == len(data) and found["a"].entropy == 8.0 and found["a"].is_packed
    assert found["b"].n_bytes == 0 and found["b"].entropy == 0.0
    for df in (triage.byte_entropy(files), triage.pe_sections(files), triage.protector_report(files)):
        assert _plan(df).count("ArrowEvalPython") == 1
    regions = files.select(F.lit(1).alias("pid"), F.lit(0).alias("base_address"), "content", F.lit("a.dll").alias("mapped_file"))
    assert _plan(triage.memory_region_triage(regions)).count("ArrowEvalPython") == 1
    # Below the window only lengths and matches are left of a text.
    for df in (triage.syscall_stubs(files), triage.stack_strings(files)):
        below = _plan(df).split("Window", 1)[1].splitlines()[1]
        assert ".gap" in below and "_text" not in below


def test_ten_thousand_indicators(spark):
    """The same hits as a plain search, in one part or in many; one string inside another, and over non-ASCII text."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcd\u00e9", k=rnd.randrange(2, 9))) for _ in range(10_000)]
    texts = ["".join(rnd.choices("abcd\u00e9 ", k=300)) for _ in range(12)] + ["", None]
    rows = spark.createDataFrame([(f"f{i}", 7, x) for i, x in enumerate(texts)], "path string, indicator_count int, body string")
    listed = spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "w string")
    want = sorted((f"f{i}", 7, w) for i, x in enumerate(texts) for w in set(words) if x and w in x)
    for limit in (triage.INDICATOR_BYTES, 20_000):
        found = triage.indicator_matches(rows, listed, "body", limit)
        assert found.columns == ["path", "indicator_count", "indicator"]
        assert sorted(map(tuple, found.collect())) == want and want
    binary = files(spark, b"\0\xffMZ\xc3\xa9x", b"none")
    assert [tuple(r) for r in triage.indicator_matches(binary, spark.createDataFrame([("\u00e9x",), ("q",)], "w string")).collect()] == [("f0", "\u00e9x")]
    assert triage.indicator_matches(rows, listed.where("false"), "body").count() == 0


def test_hidden_strings_are_read_where_they_lie(spark):
    """No row for every piece of a file and no shuffle; many hits in one run are one finding."""
    long = bytes(b ^ 0x21 for b in b"\0" + b"api http cmd " * 5000 + b"\0")
    cases = [long, b"\x80" + long + b"\x80" + long, bytes(range(256)) * 8, b"\0" * 500]
    found = triage.xor_strings(files(spark, *cases))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.path, r.offset, r.value, r.method) for r in found.collect())
    assert got == sorted((f"f{i}", *hit) for i, c in enumerate(cases) for hit in scan_xor(c))
    assert len([x for x in got if x[0] == "f1"]) >= 2


def test_byte_counts_take_little_memory():
    """A batch of chunks is counted in arrays, not in an object of 64-bit numbers for every chunk."""
    chunks = pa.array([bytes(range(256)) * 4, b"", None, b"\xff\xff\0"], pa.binary())
    for part in (chunks, chunks[1:]):
        counts = triage._histogram.func(part)
        assert isinstance(counts, pa.ListArray) and counts.type.value_type == pa.int32()
        want = [np.bincount(np.frombuffer(x or b"", np.uint8), minlength=256).tolist() for x in part.to_pylist()]
        assert counts.to_pylist() == want
