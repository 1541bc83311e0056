"""Removal of private data before events leave the platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrilake.functions.fields import drop_sensitive_env_keys, payload, privacy_rank
from sentrilake.schema import PRIVACY_LEVELS


def is_allowed(allowed: str = "INTERNAL") -> Column:
    """Whether an event may leave at this privacy level."""
    return privacy_rank(F.col("privacy")) <= PRIVACY_LEVELS.index(allowed) + 1


def sanitize_events(
    events: DataFrame,
    allowed: str = "INTERNAL",
    redact_usernames: bool = True,
    redact_raw_evidence: bool = False,
) -> DataFrame:
    """Drop rows above the allowed level and mask fields of the rest.

    Names of credential-like environment variables go from process starts, and
    content hashes of sensitive file writes are replaced even if they were null.
    """
    kept = events.filter(is_allowed(allowed))
    kind = F.col("event_type")
    keys = F.when(
        kind == "ProcessStart", drop_sensitive_env_keys(payload("environment_keys"))
    ).otherwise(payload("environment_keys"))
    digest = F.when(
        (kind == "FileWrite") & (F.col("privacy") == "SENSITIVE"), F.lit("[REDACTED_HASH]")
    ).otherwise(payload("content_hash"))
    changed = F.struct(
        F.col("data.category").alias("category"),
        F.col("data.payload")
        .withField("environment_keys", keys)
        .withField("content_hash", digest)
        .alias("payload"),
    )
    out = kept.withColumn("data", changed)
    if redact_usernames:
        user = F.col("process_identity.user")
        masked = F.when(user.isNotNull(), F.lit("[REDACTED_USER]"))
        out = out.withColumn(
            "process_identity", F.col("process_identity").withField("user", masked)
        )
    if redact_raw_evidence:
        out = out.withColumn("raw_evidence", F.create_map().cast("map<string,string>"))
    return out
