"""Event exports. All of them sanitize first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrilake.functions.fields import JSON_OPTIONS, pid, process_name, sarif_level, utc_instant
from sentrilake.functions.ruletext import uuid_text
from sentrilake.operators.detect import risk_score, scan
from sentrilake.operators.ordering import bucket_of, dense_position, first_per_session
from sentrilake.operators.privacy import is_allowed, sanitize_events
from sentrilake.sources.rules import Rule

KEY = "artifact_id"


def write_json(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sanitized events, one JSON object per line."""
    sanitize_events(events).write.mode(mode).options(**JSON_OPTIONS).json(path)


write_ndjson = write_json


def write_parquet(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    sanitize_events(events).write.mode(mode).parquet(path)


def csv_rows(events: DataFrame) -> DataFrame:
    return sanitize_events(events).select(
        "event_id", "event_type", process_name().alias("process_name"), pid().alias("pid"),
        "confidence", "privacy",
    )


def write_csv(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    csv_rows(events).write.mode(mode).option("header", True).csv(path)


def to_stix(events: DataFrame, per_bundle: int = 10_000) -> DataFrame:
    """STIX bundles: (session, part, bundle JSON).

    The sanitized events of a session are numbered in session order. Up to
    ``per_bundle`` of them are one bundle; a larger session is a series of
    bundles, so no task builds a document of unbounded size. Object keys keep
    counting across parts. Ids and times come from the data and do not change on
    a rerun. A session without an event that may leave gets one bundle with no objects
    and the times of the session.
    """
    objects_of = sanitize_events(events).select(
        KEY,
        "seq",
        "timestamp_wall",
        F.struct(
            F.lit("process").alias("type"),
            pid().alias("pid"),
            process_name().alias("name"),
            F.col("process_identity.executable_path").alias("command_line"),
        ).alias("_sco"),
    )
    clean = dense_position(objects_of, [KEY], ["seq"], "_pos").withColumn(
        "part", bucket_of(F.col("_pos"), per_bundle)
    )
    objects = F.map_from_entries(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_pos", "_sco"))),
            lambda e: F.struct(e["_pos"].cast("string"), e["_sco"]),
        )
    )

    def ident(kind: str):
        digest = F.md5(F.concat_ws("|", F.lit(kind), KEY, F.col("part").cast("string")))
        return F.concat(F.lit(f"{kind}--"), uuid_text(digest))

    def when(name: str):
        return utc_instant(F.col(name))

    grouped = clean.groupBy(KEY, "part").agg(
        F.min("timestamp_wall").alias("_first"),
        F.max("timestamp_wall").alias("_last"),
        F.count("*").alias("_n"),
        objects.alias("_objects"),
    )
    no_objects = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(
        f"array<{objects_of.schema['_sco'].dataType.simpleString()}>"))
    bare = (
        events.groupBy(KEY)
        .agg(
            F.min("timestamp_wall").alias("_first"),
            F.max("timestamp_wall").alias("_last"),
            F.count_if(is_allowed()).alias("_n"),
        )
        .filter(F.col("_n") == 0)
        .select(
            KEY, F.lit(0).cast(grouped.schema["part"].dataType).alias("part"), "_first", "_last",
            "_n", no_objects.alias("_objects"),
        )
    )
    grouped = grouped.unionByName(bare)
    observed = F.struct(
        F.lit("observed-data").alias("type"),
        F.lit("2.1").alias("spec_version"),
        ident("observed-data").alias("id"),
        when("_last").alias("created"),
        when("_last").alias("modified"),
        when("_first").alias("first_observed"),
        when("_last").alias("last_observed"),
        F.col("_n").alias("number_observed"),
        F.col("_objects").alias("objects"),
    )
    bundle = F.struct(
        F.lit("bundle").alias("type"), ident("bundle").alias("id"), F.array(observed).alias("objects")
    )
    return grouped.select(KEY, "part", F.to_json(bundle).alias("bundle"))


def to_sarif(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """One SARIF 2.1.0 document per session, over its events that may leave, if any."""
    scanned = scan(events, rules, among=is_allowed())
    results = F.transform(
        "alerts",
        lambda a: F.struct(
            a["rule_id"].alias("ruleId"),
            sarif_level(a["severity"]).alias("level"),
            F.struct(F.concat(a["title"], F.lit(": "), a["remediation"]).alias("text")).alias(
                "message"
            ),
            F.array(
                F.struct(
                    F.struct(F.struct(F.col(KEY).alias("uri")).alias("artifactLocation")).alias(
                        "physicalLocation"
                    )
                )
            ).alias("locations"),
        ),
    )
    driver = F.struct(
        F.struct(F.lit("sentrilake").alias("name"), F.lit("0.1.0").alias("version")).alias("driver")
    )
    runs = F.array(F.struct(driver.alias("tool"), results.alias("results")))
    # "$schema" cannot be a struct field that later code would quote, so it is
    # put in front of the generated object.
    body = F.to_json(F.struct(F.lit("2.1.0").alias("version"), runs.alias("runs")))
    head = (
        '{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/'
        'sarif-schema-2.1.0.json",'
    )
    return scanned.select(KEY, F.concat(F.lit(head), F.substr(body, F.lit(2))).alias("sarif"))


def incident_context(events: DataFrame, rules: list[Rule], sample: int = 50) -> DataFrame:
    """One Markdown text per session: facts, alerts and its first events."""
    clean = sanitize_events(events)
    scanned = scan(events, rules, among=is_allowed())
    first = (
        first_per_session(clean, sample)
        .select(
            KEY,
            "position",
            F.to_json(
                F.struct(*[c for c in clean.columns if c not in (KEY, "host_id", "seq")]),
                JSON_OPTIONS,
            ).alias("_json"),
        )
        .groupBy(KEY)
        .agg(F.array_sort(F.collect_list(F.struct("position", "_json"))).alias("_events"))
    )
    lines = F.transform(
        "alerts",
        lambda a: F.concat(
            F.lit("- **["), a["rule_id"], F.lit("] "), a["title"], F.lit("** (severity "),
            a["severity"], F.lit(")\n  - technique: `"),
            F.coalesce(a["mitre_technique"], F.lit("N/A")), F.lit("`\n  - action: "),
            a["remediation"],
        ),
    )
    text = F.concat(
        F.lit("# Incident context\n\n## Session\n- session: `"), F.col(KEY),
        F.lit("`\n- events: "), F.col("total_events").cast("string"),
        F.lit("\n- risk score: "), risk_score().cast("string"),
        F.lit("/100\n- alerts: "), F.size("alerts").cast("string"),
        F.lit("\n\n## Alerts\n"),
        F.when(F.size("alerts") == 0, F.lit("- none")).otherwise(F.array_join(lines, "\n")),
        F.lit("\n\n## First events\n```json\n["),
        F.coalesce(F.array_join(F.transform("_events", lambda e: e["_json"]), ",\n"), F.lit("")),
        F.lit("]\n```\n\n## Questions\n1. What started the activity?\n"
              "2. Which addresses, files and programs are involved?\n"
              "3. Which detection rules would catch it again?\n"),
    )
    return scanned.join(first, KEY, "left").select(KEY, text.alias("markdown"))
