"""Queries over binary content.

The files are built from ``documents``: a header of some format, or code bytes,
around the text. The bytes are spelled in hex by SQL that both engines run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrilake.operators import triage
from sentrilake.plans.adapter import load, stored
from sentrilake.plans.query import Query
from sentrilake.sources.binaries import WHOLE_BYTES, read_binaries

PE_HEADER_BYTES = 448


def _le32(number: str) -> str:
    digits = f"printf('%08X', {number})"
    return "concat(" + ", ".join(f"substr({digits}, {i}, 2)" for i in (7, 5, 3, 1)) + ")"


def _zeros(n: int) -> str:
    return f"repeat('00', {n})"


_SIZE = "octet_length(encode(body))"


def _pe_header(size: str) -> str:
    return "concat(" + ", ".join(
        [
            "'4D5A'", _zeros(58), "'90000000'", _zeros(64),
            "CASE WHEN doc_id % 8 = 0 THEN '52696368' ELSE '00000000' END", _zeros(12),
            "'5045000064860100'", _le32("doc_id"), _zeros(8), "'F0002200'",
            "'0B02'", _zeros(14), _le32("4096 + doc_id"), _zeros(4), "'0000004001000000'",
            _zeros(24), "'00300000'", "'00040000'", "'00000000'", "'0300'", "'6081'", _zeros(40),
            _zeros(8), "'0020000050000000'", _zeros(56),
            "CASE WHEN doc_id % 3 = 0 THEN '0040000028000000' ELSE '0000000000000000' END",
            _zeros(48),
            "CASE WHEN doc_id % 12 = 0 THEN '2E766D7030000000' ELSE '2E74657874000000' END",
            _le32(size), "'00100000'", _le32(size), "'C0010000'", _zeros(12), "'20000060'",
        ]
    ) + ")"


def _files_sql(size: str) -> str:
    """(doc_id, path, body, header, hexed) in either engine."""
    return f"""
SELECT doc_id, path, body, header, concat(header, hex(body)) AS hexed FROM (
  SELECT doc_id, path, body, CASE doc_id % 4
    WHEN 0 THEN {_pe_header(size)}
    WHEN 1 THEN CASE WHEN doc_id % 8 = 5
      THEN concat('7F454C4602020100', {_zeros(8)}, '0003003E00000001', '0000000000401000', {_zeros(32)})
      ELSE concat('7F454C4602010100', {_zeros(8)}, '03003E0001000000', '0010400000000000', {_zeros(32)})
      END
    WHEN 2 THEN concat('CFFAEDFE', '07000001', '03000000', '02000000', '10000000', {_zeros(12)})
    ELSE '' END AS header
  FROM (
    SELECT doc_id, concat('doc-', CAST(doc_id AS VARCHAR(20))) AS path,
      CASE WHEN doc_id % 16 = 0 THEN concat(text, 'C:\\\\build\\\\app', CAST(doc_id AS VARCHAR(20)), '.pdb')
        ELSE text END AS body
    FROM {{table}}
  ) a
) b"""


# Spark reads a doubled backslash in a string literal, DuckDB a single one.
_SPARK_FILES = _files_sql("octet_length(body)").format(table="{docs}")
_DUCK_FILES = _files_sql("strlen(body)").format(table="documents").replace("\\\\", "\\")

_CODE = """CASE doc_id % 5
  WHEN 0 THEN '4C8BD1B8180000000F05C3'
  WHEN 1 THEN concat('4C8BD1B8', {le}, 'FFE09090')
  WHEN 2 THEN '6A33E80000000083042405CB'
  WHEN 3 THEN 'B855000000CD2E'
  ELSE 'C645F074C645F165C645F273C645F374C645F400' END""".format(le=_le32("doc_id"))


def _spark(spark: SparkSession, d: str, kind: str, sql: str) -> DataFrame:
    """Files spelled by ``sql``, written once like recorded files would be."""
    return stored(spark, d, kind, lambda: spark.sql(sql, docs=load(spark, d, "documents")))


def binary_files(spark: SparkSession, d: str) -> DataFrame:
    return _spark(
        spark, d, "binaries", f"SELECT path, unhex(hexed) AS content FROM ({_SPARK_FILES}) f"
    )


def code_files(spark: SparkSession, d: str) -> DataFrame:
    return _spark(
        spark, d, "code",
        f"SELECT concat('doc-', doc_id) AS path, unhex(concat(hex(text), {_CODE}, hex(text))) "
        "AS content FROM {docs}",
    )


# A word under a one-byte key, between two bytes that end the run.
_WORD = b"http://evil.test"


def _hidden() -> str:
    key = "(1 + doc_id % 255)"
    return "concat(" + ", ".join(
        f"printf('%02X', CAST({b} + {key} - 2 * ({b} & {key}) AS INT))" for b in (0, *_WORD, 0)
    ) + ")"


def xor_files(spark: SparkSession, d: str) -> DataFrame:
    return _spark(
        spark, d, "hidden",
        f"SELECT concat('doc-', doc_id) AS path, unhex(concat(hex(text), {_hidden()}, hex(text))) "
        "AS content FROM {docs}",
    )


_REGION_SQL = """SELECT doc_id % 50 AS pid, doc_id * 65536 AS base_address, doc_id,
  CASE doc_id % 4 WHEN 2 THEN 'a.dll' WHEN 3 THEN 'lib.dll' END AS mapped_file,
  concat(CASE doc_id % 4 WHEN 0 THEN '4D5A' WHEN 1 THEN 'FC4883E4F0' WHEN 2 THEN 'E8000000005D'
    ELSE '4D5A' END, hex(text)) AS hexed FROM {table}"""


def memory_regions(spark: SparkSession, d: str) -> DataFrame:
    return _spark(spark, d, "regions", _REGION_SQL.format(table="{docs}")).select(
        "pid", F.col("base_address").cast("decimal(20,0)").alias("base_address"), "mapped_file",
        F.unhex("hexed").alias("content"),
    )


def _entropy_sql(hexed: str, source: str) -> str:
    return f"""pairs AS (
  SELECT path, unnest(regexp_extract_all({hexed}, '..')) AS b FROM {source}),
per_byte AS (SELECT path, b, count(*) AS n FROM pairs GROUP BY ALL),
sizes AS (SELECT path, length({hexed}) // 2 AS n_bytes FROM {source}),
entropy AS (
  SELECT s.path, n_bytes,
    coalesce(abs(sum(n / n_bytes * log2(n / n_bytes))), 0) AS h
  FROM sizes s LEFT JOIN per_byte USING (path) GROUP BY s.path, n_bytes)"""


def _entropy(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(
        F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    return triage.byte_entropy(docs).withColumn("entropy", F.round("entropy", 6))


def _page_entropy(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "pages").select(
        F.col("page_id").alias("path"), F.encode("html", "UTF-8").alias("content")
    )
    return triage.byte_entropy(pages).withColumn("entropy", F.round("entropy", 6))


_TRIAGE_COLUMNS = [
    "path", "size_bytes", "format", "is_64bit", "is_little_endian", "os_abi", "elf_type", "machine",
    "cpu_type", "cpu_subtype", "file_type", "load_commands", "is_packed",
]


def _triage(spark: SparkSession, d: str) -> DataFrame:
    out = triage.binary_triage(binary_files(spark, d))
    return out.select(
        *_TRIAGE_COLUMNS, F.col("entry_point").cast("long").alias("entry_point"),
        F.round("entropy", 6).alias("entropy"),
    )


_TRIAGE_SQL = f"""WITH files AS ({_DUCK_FILES}), {_entropy_sql('hexed', 'files')}
SELECT path, n_bytes AS size_bytes,
  CASE doc_id % 4 WHEN 0 THEN 'PE' WHEN 1 THEN 'ELF' WHEN 2 THEN 'Mach-O' ELSE 'unknown' END AS format,
  CASE WHEN doc_id % 4 < 3 THEN true END AS is_64bit,
  CASE WHEN doc_id % 4 = 1 THEN doc_id % 8 <> 5 END AS is_little_endian,
  CASE WHEN doc_id % 4 = 1 THEN 0 END AS os_abi, CASE WHEN doc_id % 4 = 1 THEN 3 END AS elf_type,
  CASE doc_id % 4 WHEN 0 THEN 34404 WHEN 1 THEN 62 END AS machine,
  CASE WHEN doc_id % 4 = 2 THEN 16777223 END AS cpu_type,
  CASE WHEN doc_id % 4 = 2 THEN 3 END AS cpu_subtype,
  CASE WHEN doc_id % 4 = 2 THEN 2 END AS file_type,
  CASE WHEN doc_id % 4 = 2 THEN 16 END AS load_commands,
  h >= 7.2 AS is_packed,
  CASE doc_id % 4 WHEN 0 THEN 4096 + doc_id WHEN 1 THEN 4198400 END AS entry_point,
  round(h, 6) AS entropy
FROM files JOIN entropy USING (path)"""


def _headers(spark: SparkSession, d: str) -> DataFrame:
    return triage.pe_headers(binary_files(spark, d)).withColumn(
        "image_base", F.col("image_base").cast("long")
    )


_HEADERS_SQL = f"""WITH files AS ({_DUCK_FILES})
SELECT path, true AS is_64bit, 34404 AS machine, 'AMD64 / x86_64' AS machine_name,
  1 AS number_of_sections, doc_id AS timestamp, 4096 + doc_id AS entry_point,
  5368709120 AS image_base, 12288 AS size_of_image, 1024 AS size_of_headers, 0 AS checksum,
  3 AS subsystem, 'Windows Console' AS subsystem_name, 33120 AS dll_characteristics,
  doc_id % 3 = 0 AS tls_callbacks_present,
  CASE WHEN doc_id % 8 = 0 THEN sha256(unhex('52696368' || repeat('00', 12))) END AS rich_header_hash,
  CASE WHEN doc_id % 16 = 0 THEN 'app' || doc_id || '.pdb' END AS debug_pdb_path
FROM files WHERE doc_id % 4 = 0"""

_SECTIONS_SQL = f"""WITH files AS (SELECT * FROM ({_DUCK_FILES}) f WHERE doc_id % 4 = 0),
{_entropy_sql('hex(body)', 'files')}
SELECT path, 0 AS section_index, CASE WHEN doc_id % 12 = 0 THEN '.vmp0' ELSE '.text' END AS name,
  n_bytes AS virtual_size, 4096 AS virtual_address, n_bytes AS raw_data_size, 448 AS raw_data_ptr,
  1610612768 AS characteristics, true AS is_executable, true AS is_readable, false AS is_writable,
  round(h, 6) AS entropy
FROM files JOIN entropy USING (path)"""

_WORDS = ["License", "http", "@", "the ", "LdrLoadDll"]


def _listed_words(spark: SparkSession, d: str) -> DataFrame:
    """Long words of the benchmark table, looked for inside the words of the documents too."""
    words = load(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    docs = load(spark, d, "documents").select("doc_id", "text")
    return triage.indicator_matches(docs, words.where(F.length("word") >= 7), "text")


def _indicators(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return triage.indicator_strings(docs, _WORDS, ["doc_id"], F.col("text"))


def _file_triage(spark: SparkSession, d: str) -> DataFrame:
    """The table files themselves as binaries."""
    out = triage.binary_triage(read_binaries(spark, d, "*.parquet", WHOLE_BYTES))
    return out.select(
        F.substring_index("path", "/", -1).alias("file"), "size_bytes", "format", "is_packed",
        F.round("entropy", 6).alias("entropy"),
    )


_STUBS_SQL = """SELECT 'doc-' || doc_id AS path, strlen(text) AS "offset",
  CASE doc_id % 5 WHEN 0 THEN 'DirectSyscall' WHEN 1 THEN 'IndirectSyscallGadget'
    WHEN 2 THEN 'HeavensGate32To64' ELSE 'Int2EGate' END AS invocation_type,
  CASE doc_id % 5 WHEN 0 THEN 24 WHEN 1 THEN doc_id WHEN 3 THEN 85 END AS ssn,
  CASE doc_id % 5 WHEN 0 THEN 'NtAllocateVirtualMemory'
    WHEN 1 THEN CASE doc_id WHEN 63 THEN 'NtReadVirtualMemory' WHEN 85 THEN 'NtMapViewOfSection'
      WHEN 176 THEN 'NtSuspendThread' WHEN 58 THEN 'NtWriteVirtualMemory'
      ELSE 'NtUnknownSyscall_0x' || printf('%04X', doc_id) END
    WHEN 2 THEN 'Heaven''s Gate (CS 0x33 x64 Transition)' ELSE 'NtMapViewOfSection' END AS api_name
FROM documents WHERE doc_id % 5 < 4"""

BINARY_QUERIES: dict[str, Query] = {
    "byte_entropy": Query(
        _entropy,
        "WITH src AS (SELECT doc_id AS path, text FROM documents), "
        + _entropy_sql("hex(text)", "src")
        + " SELECT path, n_bytes, round(h, 6) AS entropy, h >= 7.2 AS is_packed FROM entropy",
    ),
    "page_byte_entropy": Query(
        _page_entropy,
        "WITH src AS (SELECT page_id AS path, html AS text FROM pages), "
        + _entropy_sql("hex(text)", "src")
        + " SELECT path, n_bytes, round(h, 6) AS entropy, h >= 7.2 AS is_packed FROM entropy",
    ),
    "binary_triage": Query(_triage, _TRIAGE_SQL),
    "table_file_triage": Query(_file_triage),
    "pe_headers": Query(_headers, _HEADERS_SQL),
    "pe_sections": Query(
        lambda s, d: triage.pe_sections(binary_files(s, d)).withColumn(
            "entropy", F.round("entropy", 6)
        ),
        _SECTIONS_SQL,
    ),
    "pe_data_directories": Query(
        lambda s, d: triage.pe_data_directories(binary_files(s, d)),
        """SELECT 'doc-' || doc_id AS path, 'IMPORT_TABLE' AS name, 8192 AS rva, 80 AS size
FROM documents WHERE doc_id % 4 = 0 UNION ALL
SELECT 'doc-' || doc_id, 'TLS_TABLE', 16384, 40 FROM documents WHERE doc_id % 12 = 0""",
    ),
    "rich_header_hash": Query(
        lambda s, d: triage.rich_header_hash(binary_files(s, d)),
        "SELECT 'doc-' || doc_id AS path, CASE WHEN doc_id % 8 = 0 THEN "
        "sha256(unhex('52696368' || repeat('00', 12))) END AS rich_header_hash "
        "FROM documents WHERE doc_id % 4 = 0",
    ),
    "indicator_matches": Query(
        _listed_words,
        """SELECT doc_id, indicator FROM documents, (
  SELECT DISTINCT unnest(string_split(text, ' ')) AS indicator FROM benchmark)
WHERE length(indicator) >= 7 AND contains(text, indicator)""",
    ),
    "indicator_strings": Query(
        _indicators,
        "SELECT doc_id, indicator FROM documents, (SELECT unnest("
        f"[{', '.join(repr(w) for w in _WORDS)}]) AS indicator) WHERE contains(text, indicator)",
    ),
    "syscall_stubs": Query(
        lambda s, d: triage.syscall_stubs(code_files(s, d)).drop("raw_bytes", "description"),
        _STUBS_SQL,
    ),
    "stack_strings": Query(
        lambda s, d: triage.stack_strings(code_files(s, d)),
        """SELECT 'doc-' || doc_id AS path, strlen(text) AS "offset", 'test' AS value,
  'Stack String Construction' AS method FROM documents WHERE doc_id % 5 = 4""",
    ),
    "xor_strings": Query(lambda s, d: triage.xor_strings(xor_files(s, d))),
    "memory_region_triage": Query(
        lambda s, d: triage.memory_region_triage(memory_regions(s, d))
        .drop("details")
        .withColumn("base_address", F.col("base_address").cast("long")),
        f"""SELECT pid, base_address, length(hexed) // 2 AS region_size,
  CASE doc_id % 4 WHEN 0 THEN 'ReflectiveDllInjection' ELSE 'UnbackedExecutableMemory' END
    AS injection_type,
  CASE doc_id % 4 WHEN 0 THEN 0.98 ELSE 0.95 END::DOUBLE AS confidence,
  CAST(NULL AS VARCHAR) AS target_module
FROM ({_REGION_SQL.format(table='documents')}) r
WHERE length(hexed) // 2 >= 64 AND doc_id % 4 < 2""",
    ),
    "injection_report": Query(
        lambda s, d: triage.injection_report(memory_regions(s, d)),
        f"""SELECT pid, count(*) FILTER (length(hexed) // 2 >= 64 AND doc_id % 4 < 2) AS injections,
  count(*) FILTER (length(hexed) // 2 >= 64 AND doc_id % 4 < 2) > 0 AS is_compromised
FROM ({_REGION_SQL.format(table='documents')}) r GROUP BY pid""",
    ),
    "protector_sections": Query(
        lambda s, d: triage.protector_sections(binary_files(s, d)).drop("entropy"),
        "SELECT 'doc-' || doc_id AS path, 0 AS section_index, '.vmp0' AS name, '.vmp0' AS finding "
        "FROM documents WHERE doc_id % 12 = 0",
    ),
    "protector_report": Query(
        lambda s, d: triage.protector_report(binary_files(s, d)).withColumn(
            "highest_entropy", F.round("highest_entropy", 6)
        ),
        f"""WITH files AS (SELECT * FROM ({_DUCK_FILES}) f WHERE doc_id % 4 = 0),
{_entropy_sql('hex(body)', 'files')}
SELECT path, round(h, 6) AS highest_entropy, CASE WHEN doc_id % 12 = 0 OR h >= 7.3 THEN 1 ELSE 0 END
  AS findings, doc_id % 12 = 0 OR h >= 7.3 AS is_protected FROM files JOIN entropy USING (path)""",
    ),
}
