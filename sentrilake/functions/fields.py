"""Projections of an event row: names, categories, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrilake.schema import CATEGORY_SCHEMES, PRIVACY_LEVELS, SEVERITY_SCORES


# Timestamps in JSON keep their microseconds.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def payload(name: str) -> Column:
    return F.col(f"data.payload.{name}")


def pid() -> Column:
    return F.col("process_identity.pid")


def canonical_process_name(path: Column) -> Column:
    """Text after the last slash or backslash; ``unknown`` for an empty path."""
    tail = F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    return F.when(path == "", F.lit("unknown")).when(tail == "", path).otherwise(tail)


def process_name() -> Column:
    return canonical_process_name(F.col("process_identity.executable_path"))


def when_type(cases: dict[str, Column], default: Column | None = None) -> Column:
    """CASE over ``event_type`` with one branch per entry."""
    first, *rest = cases.items()
    chain = reduce(
        lambda acc, item: acc.when(F.col("event_type") == item[0], item[1]),
        rest,
        F.when(F.col("event_type") == first[0], first[1]),
    )
    return chain if default is None else chain.otherwise(default)


def event_category(scheme: str, event_type: Column | None = None) -> Column:
    """Category of an event type in one of the three schemes, null if none."""
    kind = F.col("event_type") if event_type is None else event_type
    groups = iter(CATEGORY_SCHEMES[scheme].items())
    name, members = next(groups)
    out = F.when(kind.isin(members), F.lit(name))
    for name, members in groups:
        out = out.when(kind.isin(members), F.lit(name))
    return out


def in_category(scheme: str, name: str) -> Column:
    return F.col("event_type").isin(CATEGORY_SCHEMES[scheme][name])


def _quoted(text: Column) -> Column:
    escaped = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _quoted_list(texts: Column) -> Column:
    """Quoted texts in brackets.

    The list is joined by a control character and quoted as one text, which keeps
    the expression inside generated code.
    """
    quoted = F.replace(_quoted(F.array_join(texts, "\x01")), F.lit("\x01"), F.lit('", "'))
    return F.when(F.size(texts) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("["), quoted, F.lit("]"))
    )


def _optional(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("None")).otherwise(
        F.concat(F.lit("Some("), _quoted(text), F.lit(")"))
    )


def _text(template: str, *fields: Column) -> Column:
    """Fill the ``{}`` gaps of ``template``."""
    pieces = template.split("{}")
    parts: list[Column] = [F.lit(pieces[0])]
    for field, piece in zip(fields, pieces[1:], strict=True):
        parts += [field.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def event_summary() -> Column:
    """One line of text per event, by event type."""
    p = payload
    return when_type(
        {
            "ProcessStart": _text("exec {}", p("executable_path")),
            "ProcessExit": _text("exit code {}", p("exit_code")),
            "ProcessSpawn": _text("spawn pid:{} ({})", p("child_pid"), p("child_executable_path")),
            "FileOpen": _text("open {}", p("path")),
            "FileRead": _text("read {} bytes from {}", p("bytes_read"), p("path")),
            "FileWrite": _text("write {} bytes to {}", p("bytes_written"), p("path")),
            "FileDelete": _text("delete {}", p("path")),
            "FileRename": _text("rename {} -> {}", p("old_path"), p("new_path")),
            "DnsQuery": _text("query {}", p("query_name")),
            "DnsResponse": _text("resolved {} -> {}", p("query_name"), _quoted_list(p("addresses"))),
            "NetworkConnect": _text("connect {}:{}", p("remote_address"), p("remote_port")),
            "NetworkAccept": _text("accept from {}:{}", p("remote_address"), p("remote_port")),
            "NetworkClose": _text("close sent:{} recv:{}", p("bytes_sent"), p("bytes_received")),
            "SocketCreate": _text("socket {}/{}", p("domain"), p("protocol")),
            "CryptoOperation": _text(
                "{} algo:{} provider:{}", crypto_label(), p("algorithm"), p("provider")
            ),
            "TlsObserved": _text("TLS {} ciphersuite:{}", p("version"), _optional(p("cipher_suite"))),
            "MemoryMap": _text("mmap size:{} perm:{}", p("size_bytes"), p("permissions")),
            "MemoryProtect": _text("mprotect perm:{}", p("new_permissions")),
            "IpcConnect": _text("ipc connect {}", p("target_endpoint")),
            "IpcSend": _text("ipc send {} bytes", p("message_bytes")),
            "UserSession": _text("user {}", p("username")),
            "SystemMetadata": _text("os {} arch {}", p("os_name"), p("architecture")),
        }
    )


def crypto_label() -> Column:
    """Crypto category as a capitalized word, e.g. ``Encrypt``."""
    return F.initcap(F.lower(payload("category")))


def destination() -> Column:
    """``ip:port`` of a network event."""
    return F.concat_ws(":", payload("remote_address"), payload("remote_port").cast("string"))


def result_row() -> list[Column]:
    """The six display columns of an event."""
    return [
        F.substring("event_id", 1, 8).alias("event_id"),
        F.col("event_type"),
        process_name().alias("process"),
        pid().alias("pid"),
        event_summary().alias("summary"),
        F.col("confidence"),
    ]


_DAY_MICROS = 86_400_000_000


def utc_day(ts: Column) -> Column:
    """Date in UTC, whatever the session's time zone."""
    day = F.floor(F.unix_micros(ts) / _DAY_MICROS).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), day)


def utc_clock(ts: Column) -> Column:
    """Time of day in UTC as ``hh:mm:ss``."""
    second = F.floor(F.pmod(F.unix_micros(ts), F.lit(_DAY_MICROS)) / 1_000_000).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)


def utc_instant(ts: Column) -> Column:
    """``yyyy-mm-ddThh:mm:ss.ffffffZ``."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(utc_day(ts).cast("string"), F.lit("T"), utc_clock(ts), F.format_string(".%06dZ", micros))


def wall_text() -> Column:
    """Wall time as ``yyyy-mm-dd hh:mm:ss[.fraction] UTC``."""
    ts = F.col("timestamp_wall")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = (
        F.when(micros == 0, "")
        .when(micros % 1000 == 0, F.format_string(".%03d", (micros / 1000).cast("int")))
        .otherwise(F.format_string(".%06d", micros))
    )
    return F.concat(utc_day(ts).cast("string"), F.lit(" "), utc_clock(ts), fraction, F.lit(" UTC"))


def privacy_rank(level: Column) -> Column:
    """Position in the privacy order; unknown levels rank above all."""
    return F.coalesce(
        F.nullif(F.array_position(F.array(*map(F.lit, PRIVACY_LEVELS)), level), F.lit(0)),
        F.lit(len(PRIVACY_LEVELS) + 1).cast("long"),
    )


def severity_score(severity: Column) -> Column:
    return F.coalesce(
        *[F.when(severity == name, F.lit(score)) for name, score in SEVERITY_SCORES.items()]
    )


def risk_band(score: Column) -> Column:
    return (
        F.when(score >= 75, "CRITICAL")
        .when(score >= 40, "ELEVATED")
        .when(score > 0, "LOW RISK")
        .otherwise("BENIGN / CLEAN")
    )


def sarif_level(severity: Column) -> Column:
    return (
        F.when(severity.isin("CRITICAL", "HIGH"), "error")
        .when(severity == "MEDIUM", "warning")
        .otherwise("note")
    )


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end, never below zero."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.greatest(F.lit(0).cast("long"), F.floor(micros / 1000).cast("long"))


def drop_sensitive_env_keys(keys: Column) -> Column:
    """Remove variable names that hint at credentials."""
    return F.filter(keys, lambda name: ~F.upper(name).rlike("TOKEN|SECRET|KEY"))


def event_hash() -> Column:
    """SHA-256 over id, type, process name and the payload as JSON."""
    return F.sha2(
        F.concat(F.col("event_id"), F.col("event_type"), process_name(), F.to_json("data")), 256
    )
