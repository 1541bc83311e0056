"""Event schema and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
TEXTS = T.ArrayType(T.StringType())
TEXT_MAP = T.MapType(T.StringType(), T.StringType())
# Addresses reach 2**64 - 1, which a signed long cannot hold.
ADDRESS = T.DecimalType(20, 0)

# Event type names.
EVENT_TYPES = [
    "ProcessStart", "ProcessExit", "ProcessSpawn",
    "FileOpen", "FileRead", "FileWrite", "FileDelete", "FileRename",
    "DnsQuery", "DnsResponse",
    "NetworkConnect", "NetworkAccept", "NetworkClose", "SocketCreate",
    "CryptoOperation", "TlsObserved",
    "MemoryMap", "MemoryProtect",
    "IpcConnect", "IpcSend",
    "UserSession", "SystemMetadata",
]

# Ordered levels, lowest first.
PRIVACY_LEVELS = ["PUBLIC", "INTERNAL", "SENSITIVE", "SECRET"]
CONFIDENCE_LEVELS = ["UNKNOWN", "LOW", "MEDIUM", "HIGH"]
SEVERITY_SCORES = {"INFO": 5, "LOW": 15, "MEDIUM": 40, "HIGH": 75, "CRITICAL": 100}

FILE_TYPES = ["FileOpen", "FileRead", "FileWrite", "FileDelete", "FileRename"]
DNS_TYPES = ["DnsQuery", "DnsResponse"]
CRYPTO_TYPES = ["CryptoOperation", "TlsObserved"]
FLOW_TYPES = ["NetworkConnect", "NetworkAccept", "NetworkClose"]

# Three groupings of event types are in use; they differ on purpose.
CATEGORY_SCHEMES = {
    "manifest": {
        "process": ["ProcessStart", "ProcessSpawn", "ProcessExit"],
        "file": FILE_TYPES,
        "network": FLOW_TYPES + ["SocketCreate"],
        "dns": DNS_TYPES,
        "crypto": CRYPTO_TYPES,
    },
    "inspect": {
        "file": FILE_TYPES,
        "network": FLOW_TYPES,
        "dns": DNS_TYPES,
        "crypto": CRYPTO_TYPES,
    },
    "tree": {
        "file": FILE_TYPES,
        "network": FLOW_TYPES + DNS_TYPES,
        "crypto": CRYPTO_TYPES,
    },
}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# One nullable field per payload field of the 22 event types. Fields that share
# a name share a type, so the merged struct loses nothing.
PAYLOAD = _struct(
    executable_path=S, command_line=TEXTS, working_directory=S, parent_pid=L,
    environment_keys=TEXTS,
    exit_code=I, termination_signal=I, cpu_user_time_ms=L, cpu_system_time_ms=L,
    max_resident_set_size_bytes=L,
    child_pid=L, child_executable_path=S,
    path=S, normalized_path=S, read=B, write=B, create=B, truncate=B, append=B,
    bytes_read=L, offset=L, bytes_written=L, content_hash=S, old_path=S, new_path=S,
    query_name=S, record_type=S, addresses=TEXTS, rcode=I,
    protocol=S, local_address=S, local_port=I, remote_address=S, remote_port=I,
    remote_hostname=S, is_external=B, bytes_sent=L, bytes_received=L,
    domain=S, socket_type=S,
    category=S, algorithm=S, provider=S, key_size_bits=L, mode=S,
    version=S, cipher_suite=S, server_name=S, peer_certificate_sha256=S,
    address=ADDRESS, size_bytes=L, permissions=S, backed_file_path=S,
    old_permissions=S, new_permissions=S,
    ipc_type=S, target_endpoint=S, message_bytes=L,
    username=S, session_id=S, is_elevated=B,
    hostname=S, os_name=S, os_version=S, architecture=S, cpu_count=L,
    custom_properties=TEXT_MAP,
)

PROCESS_IDENTITY = _struct(
    pid=L, ppid=L, start_time_nanos=L, executable_path=S, executable_hash=S,
    generation_id=L, command_line=TEXTS, user=S,
)

# What a recorder writes for one event.
RECORD = T.StructType(
    [
        T.StructField("event_id", S),
        T.StructField("parent_event_id", S),
        T.StructField("causal_parent_ids", TEXTS),
        T.StructField("timestamp_wall", T.TimestampType()),
        T.StructField("timestamp_monotonic_ns", L),
        T.StructField("process_identity", PROCESS_IDENTITY),
        T.StructField("thread_identity", _struct(tid=L, thread_name=S)),
        T.StructField("platform", S),
        T.StructField("event_type", S),
        T.StructField("data", _struct(category=S, payload=PAYLOAD)),
        T.StructField("raw_evidence", TEXT_MAP),
        T.StructField("collector", S),
        T.StructField("confidence", S),
        T.StructField("privacy", S),
    ]
)

# An event table adds the session, the host and the position in the session.
EVENTS = T.StructType(
    [T.StructField("artifact_id", S), T.StructField("host_id", S), T.StructField("seq", L)]
    + RECORD.fields
)
