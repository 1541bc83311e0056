"""Static triage of binary files and memory regions.

Inputs carry ``path`` (unique) and ``content``. Header fields are column
expressions on the bytes. Byte patterns are regular expressions over the bytes
read as ISO-8859-1, where one character is one byte. Contents never pass a
shuffle: only counts, headers and findings do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

PACKED_ENTROPY = 7.20
# Bytes counted by one call; keeps an Arrow batch of full chunks small.
CHUNK = 32 * 1024
_MATCHES_AT_ONCE = 10_000

# API names that hint at injection or evasion.
SUSPICIOUS_APIS = [
    "VirtualAllocEx", "WriteProcessMemory", "CreateRemoteThread", "QueueUserAPC",
    "SetWindowsHookEx", "NtUnmapViewOfSection", "IsDebuggerPresent",
    "CheckRemoteDebuggerPresent", "AdjustTokenPrivileges", "NtQueryInformationProcess",
    "MiniDumpWriteDump", "LdrLoadDll",
]
# PE data directories in header order.
DATA_DIRECTORIES = [
    "EXPORT_TABLE", "IMPORT_TABLE", "RESOURCE_TABLE", "EXCEPTION_TABLE", "CERTIFICATE_TABLE",
    "BASE_RELOCATION_TABLE", "DEBUG", "ARCHITECTURE", "GLOBAL_PTR", "TLS_TABLE",
    "LOAD_CONFIG_TABLE", "BOUND_IMPORT", "IAT", "DELAY_IMPORT_DESCRIPTOR",
    "CLR_RUNTIME_HEADER", "RESERVED",
]
# Machine and subsystem names.
MACHINES = {0x8664: "AMD64 / x86_64", 0x014C: "i386 / x86", 0xAA64: "ARM64", 0x0200: "IA64"}
SUBSYSTEMS = {
    1: "Native Driver", 2: "Windows GUI", 3: "Windows Console", 7: "POSIX Console",
    9: "Windows CE GUI", 10: "EFI Application", 11: "EFI Boot Service Driver",
    12: "EFI Runtime Driver",
}
# System-call numbers and their API names.
SYSCALL_NAMES = {
    0x18: "NtAllocateVirtualMemory", 0x19: "NtFreeVirtualMemory", 0x23: "NtCreateThreadEx",
    0x2A: "NtUnmapViewOfSection", 0x2B: "NtOpenProcess", 0x2C: "NtOpenThread",
    0x3A: "NtWriteVirtualMemory", 0x3F: "NtReadVirtualMemory", 0x50: "NtProtectVirtualMemory",
    0x55: "NtMapViewOfSection", 0xB0: "NtSuspendThread", 0xC1: "NtResumeThread",
    0xC7: "NtQueueApcThread",
}
# Words that make an XOR-decoded run interesting.
XOR_WORDS = ["http", "cmd", "kernel", "user32", "dll", "api"]

# Byte patterns of system-call stubs: plain or jump-through stub, mode switch,
# interrupt gate. The first alternative takes the longest form that fits.
STUB_PATTERN = (
    r"(?s)\x4C\x8B\xD1\xB8.{4}(?:\x0F\x05|\xFF[\x25\xE0].{2})?"
    r"|\x6A\x33\xE8\x00{4}\x83\x04\x24."
    r"|\xB8.{4}\xCD\x2E"
)
# One stack write is C6 45 xx <byte>. Group 1 is a finished printable run: four or
# more writes before a NUL write or before other code with four bytes left. The
# other alternatives step over unfinished runs and other writes.
STACK_PATTERN = (
    r"(?s)((?:\xC6\x45.[\x20-\x7E]){4,}+)(?:\xC6\x45.\x00|(?!\xC6\x45)(?=.{4}))"
    r"|(?:\xC6\x45.[\x20-\x7E])++"
    r"|\xC6\x45.[^\x20-\x7E]"
)


@arrow_udf(T.ArrayType(T.IntegerType()))
def _histogram(chunks: pa.Array) -> pa.Array:
    """How often each byte value occurs. Counted in place, without an object for every chunk and count."""
    data = chunks.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    values = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    counts = np.empty((len(data), 256), np.int32)
    for row in range(len(data)):
        counts[row] = np.bincount(values[ends[row] : ends[row + 1]], minlength=256)
    return pa.ListArray.from_arrays(np.arange(0, counts.size + 1, 256, dtype=np.int32), counts.reshape(-1))


# So marked, filters on the result are not pushed below the call, which would run it twice.
_histogram = _histogram.asNondeterministic()


def byte_entropy(rows: DataFrame, keys: Sequence[str] = ("path",), content: str = "content") -> DataFrame:
    """Shannon entropy in bits per byte, 0 for empty content; packed from 7.2 on.

    Content is cut into chunks, so a large file is counted chunk by chunk, and
    the byte counts are summed per key. It is cut before the rows are made, so that a
    row holds its chunk alone.
    """
    return _entropy(_chunk_counts(rows, keys, content), keys)


def _chunk_counts(rows: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """(keys, _byte, _n), a row per chunk and byte value."""
    last = F.greatest(F.ceil(F.octet_length(content) / CHUNK).cast("int") - 1, F.lit(0))
    slices = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substr(content, i * CHUNK + 1, F.lit(CHUNK))
    )
    chunks = rows.select(*keys, F.explode(slices).alias("_chunk")).select(
        *keys, _histogram("_chunk").alias("_h")
    )
    return _byte_counts(chunks, keys)


def _byte_counts(histograms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _byte, _n) of histograms (keys, _h)."""
    rows = histograms.select(*keys, F.posexplode("_h").alias("_byte", "_n"))
    return rows.filter((F.col("_n") > 0) | (F.col("_byte") == 0))


def _entropy(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = rows.groupBy(*keys, "_byte").agg(F.sum("_n").alias("_n"))
    weighted = F.when(F.col("_n") > 0, F.col("_n") * F.log2("_n")).otherwise(0.0)
    total = F.col("n_bytes")
    return (
        counts.groupBy(*keys)
        .agg(F.sum("_n").alias("n_bytes"), F.sum(weighted).alias("_w"))
        .withColumn(
            "entropy",
            F.when(total == 0, F.lit(0.0)).otherwise(
                F.greatest(F.lit(0.0), F.log2(total) - F.col("_w") / total)
            ),
        )
        .withColumn("is_packed", F.col("entropy") >= PACKED_ENTROPY)
        .drop("_w")
    )


def _little(offset: Column | int, size: int, content: str = "content") -> Column:
    """Unsigned little-endian integer; null beyond the end of the content."""
    return _integer(offset, size, content, little=True)


def _integer(offset: Column | int, size: int, content: str, little: bool) -> Column:
    at = F.lit(offset) if isinstance(offset, int) else offset
    digits = F.hex(F.substr(content, at.cast("int") + 1, F.lit(size)))
    if little:
        # Swap hex pairs; reverse() on bytes would treat them as text.
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    kind = "decimal(20,0)" if size == 8 else "long"
    fits = F.octet_length(content) >= at + size
    return F.when(fits, F.conv(digits, 16, 10).cast(kind))


def _bytes_at(offset: Column | int, wanted: bytes) -> Column:
    at = F.lit(offset) if isinstance(offset, int) else offset
    found = F.hex(F.substr("content", at.cast("int") + 1, F.lit(len(wanted))))
    return found == wanted.hex().upper()


def _latin(content: str | Column = "content") -> Column:
    return F.decode(content, "ISO-8859-1")


def _named(number: Column, names: dict[int, str], default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, number.cast("int")), default)


def _pe_start() -> Column:
    """Offset of the PE header; null if the content is not a PE file."""
    size = F.octet_length("content")
    start = F.when((size >= 64) & _bytes_at(0, b"MZ"), _little(0x3C, 4))
    return F.when(
        (start < 2**31 - 64) & (size >= start + 24) & _bytes_at(start, b"PE\0\0"), start
    )


def _pe_files(files: DataFrame) -> DataFrame:
    """PE files with ``_pe`` and ``_opt``, the offsets of their two headers.

    The offset goes through ``explode``, which drops other files and makes Spark
    compute it once instead of repeating its expression in every field.
    """
    return files.select(
        "path", "content", F.explode(F.array_compact(F.array(_pe_start()))).alias("_pe")
    ).withColumn("_opt", F.col("_pe") + 24)


def pe_headers(files: DataFrame) -> DataFrame:
    """Header fields of PE files; other files are left out."""
    opt, pe = F.col("_opt"), F.col("_pe")
    is64 = F.col("is_64bit")
    machine, subsystem = F.col("machine"), F.col("subsystem")
    tls_entry = F.when(is64, opt + 112).otherwise(opt + 96) + 8 * DATA_DIRECTORIES.index("TLS_TABLE")
    has_tls = (
        (tls_entry + 8 <= opt + F.col("_optional_size"))
        & (_little(tls_entry, 4) > 0)
        & (_little(tls_entry + 4, 4) > 0)
    )
    base = F.when(is64, _little(opt + 24, 8)).otherwise(
        F.when(F.octet_length("content") >= opt + 32, _little(opt + 28, 4)).cast("decimal(20,0)")
    )
    rich = F.substr("content", F.lit(0x81), (pe - 0x80).cast("int"))
    has_rich = (pe > 0x80) & F.contains(_latin(rich), F.lit("Rich"))
    return (
        _pe_files(files)
        .withColumn("is_64bit", F.coalesce(_little(opt, 2) == 0x20B, F.lit(False)))
        .withColumn("machine", _little(pe + 4, 2))
        .withColumn("_optional_size", _little(pe + 20, 2))
        .withColumn("subsystem", _little(opt + 68, 2))
        .select(
            "path",
            "is_64bit",
            "machine",
            _named(
                machine, MACHINES, F.concat(F.lit("Unknown (0x"), F.hex(machine), F.lit(")"))
            ).alias("machine_name"),
            _little(pe + 6, 2).alias("number_of_sections"),
            _little(pe + 8, 4).alias("timestamp"),
            _little(opt + 16, 4).alias("entry_point"),
            F.coalesce(base, F.lit(0).cast("decimal(20,0)")).alias("image_base"),
            _little(opt + 56, 4).alias("size_of_image"),
            _little(opt + 60, 4).alias("size_of_headers"),
            _little(opt + 64, 4).alias("checksum"),
            "subsystem",
            _named(
                subsystem, SUBSYSTEMS,
                F.concat(F.lit("Other ("), subsystem.cast("string"), F.lit(")")),
            ).alias("subsystem_name"),
            _little(opt + 70, 2).alias("dll_characteristics"),
            F.coalesce(has_tls, F.lit(False)).alias("tls_callbacks_present"),
            F.when(has_rich, F.sha2(rich, 256)).alias("rich_header_hash"),
            pdb_path().alias("debug_pdb_path"),
        )
    )


def pdb_path() -> Column:
    """Debug file name before the first ``.pdb``, if shorter than 128 characters."""
    text = _latin()
    at = F.instr(text, ".pdb")
    head = F.substr(text, F.lit(1), at - 1)
    tail = F.substring_index(F.translate(head, "/", "\\"), "\\", -1)
    name = F.regexp_replace(F.concat(tail, F.lit(".pdb")), r"^\p{Cc}+|\p{Cc}+$", "")
    return F.when((at > 0) & (F.length(name) < 128), name)


def rich_header_hash(files: DataFrame) -> DataFrame:
    return pe_headers(files).select("path", "rich_header_hash")


def pe_data_directories(files: DataFrame) -> DataFrame:
    """Filled data directories of PE files."""
    opt = F.col("_opt")
    start = F.when(F.coalesce(_little(opt, 2) == 0x20B, F.lit(False)), opt + 112).otherwise(opt + 96)
    end = opt + _little(F.col("_pe") + 20, 2)
    entries = []
    for index, name in enumerate(DATA_DIRECTORIES):
        at = start + 8 * index
        entries.append(
            F.when(
                at + 8 <= end,
                F.struct(
                    F.lit(name).alias("name"), _little(at, 4).alias("rva"),
                    _little(at + 4, 4).alias("size"),
                ),
            )
        )
    return (
        _pe_files(files)
        .select("path", F.inline(F.array_compact(F.array(*entries))))
        .filter((F.col("rva") > 0) & (F.col("size") > 0))
    )


def _section_headers() -> Column:
    """Index and offset of the section headers that end within the file."""
    count = _little(F.col("_pe") + 6, 2).cast("int")
    table = F.col("_opt") + _little(F.col("_pe") + 20, 2)
    places = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)),
        lambda i: F.struct(i.alias("section_index"), (table + i * 40).alias("_at")),
    )
    return F.filter(places, lambda h: h["_at"] + 40 <= F.octet_length("content"))


def _section_data(at: Column) -> Column:
    """Data of the section whose header is at ``at``; empty if it lies outside the file."""
    size, start = _little(at + 16, 4), _little(at + 20, 4)
    return F.when(
        start + size <= F.octet_length("content"),
        F.substr("content", start.cast("int") + 1, size.cast("int")),
    ).otherwise(F.substr("content", F.lit(1), F.lit(0)))


def pe_sections(files: DataFrame) -> DataFrame:
    """One row per section header that lies within the file, with its entropy.

    A section whose data lies outside the file counts as empty.
    """
    at, flags = F.col("_at"), F.col("characteristics")
    rows = _pe_files(files).select("path", "content", F.inline(_section_headers()))
    name = F.regexp_replace(
        F.decode(F.substr("content", at.cast("int") + 1, F.lit(8)), "ISO-8859-1"), r"^\x00+|\x00+$", ""
    )
    headers = rows.select(
        "path", "section_index", name.alias("name"),
        _little(at + 8, 4).alias("virtual_size"), _little(at + 12, 4).alias("virtual_address"),
        _little(at + 16, 4).alias("raw_data_size"), _little(at + 20, 4).alias("raw_data_ptr"),
        _little(at + 36, 4).alias("characteristics"),
    ).select(
        "*",
        (flags.bitwiseAND(0x20000000) != 0).alias("is_executable"),
        (flags.bitwiseAND(0x40000000) != 0).alias("is_readable"),
        (flags.bitwiseAND(F.lit(0x80000000)) != 0).alias("is_writable"),
    )
    entropy = byte_entropy(
        rows.select("path", "section_index", _section_data(at).alias("_data")),
        ["path", "section_index"], "_data",
    ).select("path", "section_index", "entropy")
    return headers.join(entropy, ["path", "section_index"])


def binary_triage(files: DataFrame) -> DataFrame:
    """Format, size, entropy and packing verdict of each file.

    Files that ``read_binaries`` gives by ``head`` and ``counts`` instead of a content are judged by these.
    """
    large = None
    if "counts" in files.columns:
        large, files = files.where("counts IS NOT NULL"), files.where("counts IS NULL")
    size = F.col("size_bytes")
    little = F.hex(F.substr("content", F.lit(6), F.lit(1))) == "01"
    wide = F.hex(F.substr("content", F.lit(5), F.lit(1))) == "02"

    def word(offset: int, n: int) -> Column:
        return F.when(little, _integer(offset, n, "content", True)).otherwise(
            _integer(offset, n, "content", False)
        )

    is_elf = (size >= 52) & _bytes_at(0, b"\x7fELF")
    magic = _little(0, 4)
    macho64 = magic.isin(0xFEEDFACF, 0xCFFACEDF)
    macho32 = magic.isin(0xFEEDFACE, 0xCEFAEDFE)
    is_macho = (size >= 32) & (macho64 | macho32)
    kind = (
        F.when(F.col("_pe").isNotNull(), "PE")
        .when(is_elf, "ELF")
        .when(is_macho, "Mach-O")
        .otherwise("unknown")
    )
    fmt = F.col("format")
    elf, macho = fmt == "ELF", fmt == "Mach-O"
    # The generators make Spark compute the header offset and the format once.
    located = files.select(
        "path", "content", F.octet_length("content").cast("long").alias("size_bytes"),
        F.explode(F.array(F.struct(_pe_start().alias("_pe")))).alias("_h"),
    ).select("path", "content", "size_bytes", "_h._pe", (F.col("_h._pe") + 24).alias("_opt"))
    judged = located
    if large is not None:
        judged = located.unionByName(
            large.select(
                "path", F.col("head").alias("content"), F.col("length").alias("size_bytes"),
                F.lit(None).cast("long").alias("_pe"), F.lit(None).cast("long").alias("_opt"),
            )
        )
    facts = (
        judged.select("*", F.explode(F.array(kind)).alias("format"))
        .select(
            "path",
            "size_bytes",
            "format",
            F.when(fmt == "PE", F.coalesce(_little(F.col("_opt"), 2) == 0x20B, F.lit(False)))
            .when(elf, wide)
            .when(macho, macho64)
            .alias("is_64bit"),
            F.when(elf, little).alias("is_little_endian"),
            F.when(elf, _little(7, 1)).alias("os_abi"),
            F.when(elf, word(16, 2)).alias("elf_type"),
            F.when(elf, word(18, 2))
            .when(fmt == "PE", _little(F.col("_pe") + 4, 2))
            .alias("machine"),
            F.when(elf & wide, word(24, 8))
            .when(elf, word(24, 4).cast("decimal(20,0)"))
            .when(fmt == "PE", _little(F.col("_opt") + 16, 4).cast("decimal(20,0)"))
            .alias("entry_point"),
            F.when(macho, _little(4, 4)).alias("cpu_type"),
            F.when(macho, _little(8, 4)).alias("cpu_subtype"),
            F.when(macho, _little(12, 4)).alias("file_type"),
            F.when(macho, _little(16, 4)).alias("load_commands"),
        )
    )
    # The whole file (part -1) and its sections are counted in one pass.
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.col("content").alias("data")))
    sections = F.transform(
        F.when(F.col("_pe").isNotNull(), _section_headers()),
        lambda h: F.struct(h["section_index"].alias("part"), _section_data(h["_at"]).alias("data")),
    )
    parts = located.select(
        "path", F.inline(F.when(sections.isNull(), whole).otherwise(F.concat(whole, sections)))
    )
    counts = _chunk_counts(parts, ["path", "part"], "data")
    if large is not None:
        whole_counts = large.select("path", F.lit(-1).alias("part"), F.col("counts").alias("_h"))
        counts = counts.unionByName(_byte_counts(whole_counts, ["path", "part"]))
    entropy = (
        _entropy(counts, ["path", "part"])
        .groupBy("path")
        .agg(
            F.max(F.when(F.col("part") == -1, F.col("entropy"))).alias("entropy"),
            F.count_if((F.col("part") >= 0) & (F.col("entropy") >= PACKED_ENTROPY)).alias("_dense"),
        )
    )
    h = F.col("entropy")
    by_format = (
        F.when(fmt == "PE", (h > 7.3) | (F.col("_dense") > 0))
        .when(elf | macho, h > 7.35)
        .otherwise(False)
    )
    return (
        facts.join(entropy, "path")
        .withColumn("is_packed", by_format | (h >= PACKED_ENTROPY))
        .drop("_dense")
    )


def indicator_strings(
    rows: DataFrame,
    indicators: Sequence[str] = tuple(SUSPICIOUS_APIS),
    keys: Sequence[str] = ("path",),
    text: Column | None = None,
) -> DataFrame:
    """(keys, indicator) for each listed string that occurs in the content.

    The list is configuration, so it is part of the expression; nothing is joined.
    """
    body = _latin() if text is None else text
    found = [F.when(F.contains(body, F.lit(name)), F.lit(name)) for name in indicators]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("indicator"))


#: Bytes of the listed strings in one automaton, which every Python worker builds; longer lists take several passes.
INDICATOR_BYTES = 16 << 20


def indicator_matches(rows: DataFrame, indicators: DataFrame, content: str = "content", limit: int = INDICATOR_BYTES) -> DataFrame:
    """``rows`` without ``content``, and ``indicator``: each string of ``indicators`` (one column) that occurs in the text
    or bytes of ``content``, found for all strings in one reading by an Aho-Corasick automaton.

    The strings are broadcast in parts of at most ``limit`` bytes, so any number of them is exact; one part holds
    some hundred thousand. Empty and null strings are left out, strings that repeat are one, and a null content has
    no hits. Nothing is shuffled.
    """
    spark = rows.sparkSession
    name = indicators.columns[0]
    listed = indicators.select(F.col(name).cast("string").alias("indicator")).where(F.length("indicator") > 0).distinct()
    total = listed.agg(F.sum(F.octet_length("indicator"))).first()[0] or 0
    parts = -(-total // limit) or 1
    dealt = listed.withColumn("_part", F.pmod(F.xxhash64("indicator"), F.lit(parts)))
    others = [c for c in rows.columns if c != content]
    body = rows.select(*others, F.col(content).cast("binary").alias("_content")).where("_content IS NOT NULL")
    schema = T.StructType([*rows.select(*others).schema.fields, T.StructField("indicator", T.StringType())])
    passes = []
    for part in range(parts):
        known = spark.sparkContext.broadcast([r[0] for r in dealt.where(F.col("_part") == part).select("indicator").collect()])

        def find(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            # A character for each byte, in the strings as in the content.
            for text in known.value:
                automaton.add_word(text.encode().decode("latin-1"), text)
            automaton.make_automaton()
            for batch in batches:
                place, found = [], []
                for i in range(batch.num_rows if known.value else 0):
                    data = batch["_content"][i].as_py().decode("latin-1")
                    hits = {text for _, text in automaton.iter(data)}
                    place += [i] * len(hits)
                    found += hits
                if found:
                    kept = batch.select(others).take(pa.array(place))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string())], [*others, "indicator"])

        passes.append(body.mapInArrow(find, schema))
    return reduce(DataFrame.unionByName, passes)


def _matches(files: DataFrame, pattern: str, group: int = 0) -> DataFrame:
    """(path, offset, match, part) of all matches, left to right, from one reading of every file.

    Bytes are given as ISO-8859-1 text. A task yields the matches of a file in slices; nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(pattern.encode("latin-1"))
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = wanted.finditer(content.as_py())
                while part := list(islice(found, _MATCHES_AT_ONCE)):
                    columns = [
                        pa.array([path.as_py()] * len(part), pa.string()),
                        pa.array([m.start() for m in part], pa.int64()),
                        pa.array([m[0].decode("latin-1") for m in part], pa.string()),
                        pa.array([(m[group] or b"").decode("latin-1") for m in part], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "offset", "match", "part"])

    rows = files.select("path", F.col("content").cast("binary").alias("content")).where("content IS NOT NULL")
    return rows.mapInArrow(scan, "path string, offset long, match string, part string")


def syscall_stubs(files: DataFrame) -> DataFrame:
    """System-call stubs in code, scanned left to right without overlap."""
    raw = F.hex(F.encode("match", "ISO-8859-1"))

    def number(start: int) -> Column:
        """Little-endian number in the four bytes from ``start``."""
        pairs = [F.substring(raw, 2 * (start + i) + 1, 2) for i in (3, 2, 1, 0)]
        return F.conv(F.concat(*pairs), 16, 10).cast("long")

    stub, gate = raw.startswith("4C8BD1B8"), raw.startswith("6A33")
    jump = stub & (F.length(raw) == 24)
    ssn = F.col("ssn")
    unknown = F.concat(
        F.when(F.col("invocation_type") == "Int2EGate", "NtLegacySyscall_0x").otherwise(
            "NtUnknownSyscall_0x"
        ),
        F.format_string("%04X", ssn),
    )
    kind = (
        F.when(jump, "IndirectSyscallGadget")
        .when(stub, "DirectSyscall")
        .when(gate, "HeavensGate32To64")
        .otherwise("Int2EGate")
    )
    invocation = F.col("invocation_type")
    description = (
        F.when(invocation == "IndirectSyscallGadget", "System call through a jump to other code")
        .when(invocation == "DirectSyscall", "Direct system call that bypasses the API layer")
        .when(invocation == "HeavensGate32To64", "Switch from 32-bit to 64-bit mode")
        .otherwise("System call through interrupt 0x2E")
    )
    return (
        _matches(files, STUB_PATTERN)
        .withColumn("invocation_type", kind)
        .withColumn("ssn", F.when(stub, number(4)).when(~gate, number(1)))
        .select(
            "path", "offset", "invocation_type", "ssn",
            F.when(
                ssn.isNull(), F.lit("Heaven's Gate (CS 0x33 x64 Transition)")
            ).otherwise(_named(ssn, SYSCALL_NAMES, unknown)).alias("api_name"),
            raw.alias("raw_bytes"),
            description.alias("description"),
        )
    )


@pandas_udf(T.DoubleType())
def _small_entropy(slices: pd.Series) -> pd.Series:
    """Entropy of slices of a few kilobytes."""

    def entropy(data: bytes) -> float:
        counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        share = counts[counts > 0] / max(len(data), 1)
        return float(-(share * np.log2(share)).sum()) if len(share) else 0.0

    return slices.map(entropy)


_small_entropy = _small_entropy.asNondeterministic()


def memory_region_triage(regions: DataFrame) -> DataFrame:
    """Injection findings of memory regions (pid, base_address, content, mapped_file)."""
    size = F.octet_length("content")
    header = _bytes_at(0, b"MZ")
    backed = F.col("mapped_file").isNotNull()
    stompable = header & F.col("mapped_file").endswith(".dll") & (size > 0x1000)
    code = F.when(stompable, F.substr("content", F.lit(0x1001), F.lit(0x2000)))
    stager = _bytes_at(0, b"\xfc\x48\x83\xe4\xf0") | _bytes_at(0, b"\xe8\0\0\0\0\x5d")
    checked = regions.filter(size >= 0x40).withColumn(
        "_code_entropy", F.when(stompable, _small_entropy(F.coalesce(code, F.lit(b""))))
    )
    kind = (
        F.when(header & ~backed, "ReflectiveDllInjection")
        .when(stompable & (F.col("_code_entropy") >= PACKED_ENTROPY), "ModuleStomping")
        .when(~header & ~backed & stager, "UnbackedExecutableMemory")
    )
    found = F.col("injection_type")
    details = (
        F.when(found == "ReflectiveDllInjection", "Private memory holds an executable header")
        .when(
            found == "ModuleStomping",
            F.format_string(
                "Code of mapped '%s' has packed entropy (%.2f)", "mapped_file", "_code_entropy"
            ),
        )
        .otherwise("Private memory starts with a known stager prologue")
    )
    confidence = (
        F.when(found == "ReflectiveDllInjection", 0.98)
        .when(found == "ModuleStomping", 0.92)
        .otherwise(0.95)
    )
    return (
        checked.withColumn("injection_type", kind)
        .filter(found.isNotNull())
        .select(
            "pid", "base_address", size.cast("long").alias("region_size"), "injection_type",
            confidence.alias("confidence"),
            F.when(found == "ModuleStomping", F.col("mapped_file")).alias("target_module"),
            details.alias("details"),
        )
    )


def injection_report(regions: DataFrame) -> DataFrame:
    """Number of findings per process, clean processes included."""
    found = memory_region_triage(regions).groupBy("pid").agg(F.count("*").alias("injections"))
    return (
        regions.select("pid")
        .distinct()
        .join(found, "pid", "left")
        .select(
            "pid",
            F.coalesce("injections", F.lit(0)).cast("long").alias("injections"),
            F.col("injections").isNotNull().alias("is_compromised"),
        )
    )


def stack_strings(files: DataFrame) -> DataFrame:
    """Strings that code builds on the stack byte by byte."""
    value = F.regexp_replace("part", r"(?s)...(.)", "$1")
    return (
        _matches(files, STACK_PATTERN, group=1)
        .filter(F.col("part") != "")
        .select(
            "path", "offset", value.alias("value"),
            F.lit("Stack String Construction").alias("method"),
        )
    )


@lru_cache(None)
def _run_under(key: int) -> re.Pattern[bytes]:
    """Bytes that are printable once ``key`` is taken off."""
    return re.compile(b"[" + b"".join(b"\\x%02x" % (b ^ key) for b in range(0x20, 0x7F)) + b"]*+")


def _hidden_runs(content: bytes) -> Iterator[tuple[int, str, int]]:
    """(offset, decoded text, key) of the printable runs around the words.

    The XOR of neighbouring bytes does not depend on the key, so one search for
    the word's own differences finds every occurrence under any key. A run is read
    once for every word it holds, however often the word occurs in it.
    """
    raw = np.frombuffer(content, dtype=np.uint8)
    steps = (raw[1:] ^ raw[:-1]).tobytes()
    backward, seen = b"", set()
    for word in XOR_WORDS:
        letters = np.frombuffer(word.encode(), dtype=np.uint8)
        pattern = (letters[1:] ^ letters[:-1]).tobytes()
        read: dict[int, int] = {}
        at = steps.find(pattern)
        while at >= 0:
            key = int(letters[0]) ^ content[at]
            if key and at >= read.get(key, 0):
                backward = backward or content[::-1]
                read[key] = end = _run_under(key).match(content, at).end()
                start = len(content) - _run_under(key).match(backward, len(content) - at).end()
                if end - start >= 7 and end < len(content) and (key, start) not in seen:
                    seen.add((key, start))
                    yield start, (raw[start:end] ^ np.uint8(key)).tobytes().decode("ascii"), key
            at = steps.find(pattern, at + 1)


def xor_strings(files: DataFrame) -> DataFrame:
    """Printable runs of seven or more bytes hidden by a one-byte XOR key.

    Only runs around one of the words are decoded. A run that reaches
    the end of the content is not reported. Nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = _hidden_runs(content.as_py())
                while part := list(islice(found, _MATCHES_AT_ONCE)):
                    columns = [
                        pa.array([path.as_py()] * len(part), pa.string()),
                        pa.array([offset for offset, _, _ in part], pa.int64()),
                        pa.array([value for _, value, _ in part], pa.string()),
                        pa.array([f"XOR Key 0x{key:02X}" for _, _, key in part], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "offset", "value", "method"])

    rows = files.select("path", F.col("content").cast("binary").alias("content")).where("content IS NOT NULL")
    return rows.mapInArrow(scan, "path string, offset long, value string, method string")


def protector_sections(files: DataFrame) -> DataFrame:
    """Sections of PE files that point to a code protector, by name or entropy."""
    named = F.contains(F.lower("name"), F.lit("vmp"))
    dense = F.col("entropy") >= 7.3
    return (
        pe_sections(files)
        .filter(named | dense)
        .select(
            "path", "section_index", "name", "entropy",
            F.when(named, F.col("name"))
            .otherwise(F.format_string("%s (High Entropy %.2f)", "name", "entropy"))
            .alias("finding"),
        )
    )


def protector_report(files: DataFrame) -> DataFrame:
    """One verdict per PE file; the highest section entropy also counts."""
    named = F.contains(F.lower("name"), F.lit("vmp"))
    highest = F.max("entropy")
    found = F.count_if(named | (F.col("entropy") >= 7.3))
    return (
        pe_sections(files)
        .groupBy("path")
        .agg(
            highest.alias("highest_entropy"),
            found.alias("findings"),
            ((found > 0) | (highest >= 7.35)).alias("is_protected"),
        )
    )
