"""Plain-language explanation of a session's scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrilake.functions.fields import process_name
from sentrilake.functions.ruletext import sigma_rule, yara_rule
from sentrilake.operators.detect import risk_score, scan
from sentrilake.sources.rules import Rule

KEY = "artifact_id"

#: (lowest score, tier, step that closes the list of actions). ``{}`` stands for the root program.
TIERS = (
    (75, "respond", "Contain the machine first, then follow what {} left behind."),
    (40, "review", "Give the connections and file writes of {} to an analyst."),
    (0, "archive", "Keep the record; nothing else is due."),
)


def _by_tier(risk: Column, values: list[Column]) -> Column:
    out = values[-1]
    for (least, _, _), value in reversed(list(zip(TIERS, values))[:-1]):
        out = F.when(risk >= least, value).otherwise(out)
    return out


def explain_incidents(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Summary, observations, actions and rule texts, one row per session.

    Observations name the alerts from the highest score down, then the tier; actions give their remediations, then
    the tier's own step.
    """
    root = F.min_by(process_name(), F.col("seq")).alias("root_process")
    scanned = scan(events, rules, [KEY], [root]).withColumn("risk_score", risk_score())
    risk, root = F.col("risk_score"), F.col("root_process")
    # The place of a rule in the rule set decides between equal scores.
    ranked = F.sort_array(
        F.transform(
            "alerts", lambda a: F.struct((-a["score"]).alias("low"), a["rule_index"].alias("place"), a.alias("alert"))
        )
    )
    scanned = scanned.withColumn("alerts", F.transform(ranked, lambda r: r["alert"]))
    findings = F.transform(
        "alerts",
        lambda a: F.concat(
            a["rule_id"], F.lit(" ("), F.lower(a["severity"]), F.lit(", "), a["matched_events"].cast("string"),
            F.lit(" events): "), a["title"],
            F.coalesce(F.concat(F.lit("; compare "), a["mitre_technique"]), F.lit("")),
        ),
    )
    tier = _by_tier(risk, [F.lit(name) for _, name, _ in TIERS])
    rated = F.concat(F.lit("Score "), risk.cast("string"), F.lit(" of 100, tier "), tier)
    steps = F.filter(F.transform("alerts", lambda a: a["remediation"]), lambda text: text != "")
    last = _by_tier(risk, [F.replace(F.lit(step), F.lit("{}"), root) for _, _, step in TIERS])
    summary = F.concat(
        root, F.lit(": "), F.size("alerts").cast("string"), F.lit(f" of {len(rules)} rules matched in "),
        F.col("total_events").cast("string"), F.lit(" events"),
    )
    return scanned.select(
        KEY,
        "root_process",
        "risk_score",
        summary.alias("summary"),
        F.array_append(findings, rated).alias("observations"),
        F.array_append(F.array_distinct(steps), last).alias("actions"),
        F.lit(0.95).alias("confidence"),
        yara_rule(F.col(KEY), root, risk).alias("yara_rule"),
        sigma_rule(F.col(KEY), root, risk).alias("sigma_rule"),
    )
