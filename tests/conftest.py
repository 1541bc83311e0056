from __future__ import annotations

import os
import sys
from decimal import Decimal
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sentrilake.schema import EVENTS, PAYLOAD, PROCESS_IDENTITY  # noqa: E402
from sentrilake.session import local_session  # noqa: E402

START = datetime(2024, 5, 1, 12, 0, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class EventMaker:
    """Builds small event tables; ``seq`` and the time follow the list order."""

    def __init__(self, spark):
        self.spark = spark

    def __call__(self, *specs, ordered=False):
        rows, counters = [], {}
        for spec in specs:
            spec = dict(spec)
            artifact = spec.pop("artifact", "s1")
            n = counters[artifact] = counters.get(artifact, -1) + 1
            kind = spec.pop("type")
            identity = dict.fromkeys(PROCESS_IDENTITY.fieldNames())
            identity.update(
                pid=spec.pop("pid", 100), ppid=spec.pop("ppid", None),
                executable_path=spec.pop("exe", "/usr/bin/tool"), user=spec.pop("user", None),
                start_time_nanos=0, generation_id=1,
            )
            row = {
                "artifact_id": artifact, "host_id": spec.pop("host", "h1"),
                "seq": spec.pop("seq", n), "event_id": spec.pop("id", f"{artifact}-e{n:06d}"),
                "parent_event_id": spec.pop("parent", None),
                "causal_parent_ids": spec.pop("causal", []),
                "timestamp_wall": START + timedelta(seconds=spec.pop("at", n)),
                "timestamp_monotonic_ns": 0, "process_identity": identity, "thread_identity": None,
                "platform": "linux", "event_type": kind, "raw_evidence": spec.pop("raw", {}),
                "collector": "test", "confidence": spec.pop("confidence", "HIGH"),
                "privacy": spec.pop("privacy", "PUBLIC"),
            }
            payload = dict.fromkeys(PAYLOAD.fieldNames())
            unknown = set(spec) - set(payload)
            assert not unknown, unknown
            if "address" in spec:
                spec["address"] = Decimal(spec["address"])
            payload.update(spec)
            row["data"] = {"category": kind, "payload": payload}
            if ordered:
                row["ord"] = n
            rows.append(row)
        schema = EVENTS
        if ordered:
            from pyspark.sql import types as T

            schema = T.StructType(EVENTS.fields + [T.StructField("ord", T.LongType())])
        return self.spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def make(spark):
    return EventMaker(spark)


def connect(ip="1.1.1.1", port=443, external=True, **more):
    return dict(type="NetworkConnect", protocol="TCP", remote_address=ip, remote_port=port,
                is_external=external, **more)


def opened(path, **more):
    return dict(type="FileOpen", path=path, normalized_path=path, read=True, write=False, **more)


def wrote(path, **more):
    return dict(type="FileWrite", path=path, bytes_written=10, **more)


def crypto(algorithm="SHA256", category="HASH", provider="OpenSSL", **more):
    return dict(type="CryptoOperation", category=category, algorithm=algorithm, provider=provider,
                **more)
