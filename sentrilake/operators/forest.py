"""Processes of a session and their parent tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrilake.functions.fields import canonical_process_name, in_category, payload, pid
from sentrilake.session import cut

KEY = "artifact_id"


def process_stats(events: DataFrame) -> DataFrame:
    """One row per process id with event counts and its latest known parent.

    First and last follow the order of ``event_id``.
    """
    exited = F.when(F.col("event_type") == "ProcessExit", F.col("event_id"))
    has_parent = F.when(F.col("process_identity.ppid").isNotNull(), F.col("event_id"))
    return (
        events.withColumn("pid", pid())
        .groupBy(KEY, "pid")
        .agg(
            F.count("*").alias("events"),
            F.count_if(in_category("tree", "file")).alias("files"),
            F.count_if(in_category("tree", "network")).alias("net"),
            F.count_if(in_category("tree", "crypto")).alias("crypto"),
            F.max_by(payload("exit_code"), exited).alias("exit_code"),
            F.min_by("process_identity.executable_path", "event_id").alias("_path"),
            F.min_by("process_identity.ppid", "event_id").alias("parent_pid"),
            F.max_by("process_identity.ppid", has_parent).alias("last_ppid"),
        )
        .withColumn("process_name", canonical_process_name(F.col("_path")))
        .drop("_path")
    )


def process_forest(events: DataFrame) -> DataFrame:
    """``process_stats`` plus ``depth``, ``root_pid`` and ``path`` (ids from the root).

    A process whose parent has no events is a root. Processes in a parent cycle,
    or their own parent, have no root and are left out. Ancestor pointers double
    in every round, so the rounds grow with the logarithm of the depth.
    """
    stats = cut(process_stats(events))
    known = stats.select(KEY, F.col("pid").alias("last_ppid"), F.lit(True).alias("_known"))
    placed = stats.join(known, [KEY, "last_ppid"], "left").select(
        KEY,
        "pid",
        F.when(F.col("_known"), F.col("last_ppid")).alias("up"),
        F.array("pid").alias("path"),
    )
    state = cut(placed)
    open_before = None
    while True:
        open_now = state.filter(F.col("up").isNotNull()).count()
        if open_now == 0 or open_now == open_before:
            break
        open_before = open_now
        above = state.select(
            KEY,
            F.col("pid").alias("up"),
            F.col("up").alias("_up"),
            F.col("path").alias("_path"),
        )
        climbing = (
            state.filter(F.col("up").isNotNull())
            .join(above, [KEY, "up"])
            .select(KEY, "pid", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"))
        )
        state = cut(state.filter(F.col("up").isNull()).unionByName(climbing))
    rooted = state.filter(F.col("up").isNull()).select(
        KEY, "pid", "path", (F.size("path") - 1).alias("depth"), F.col("path")[0].alias("root_pid")
    )
    return stats.join(rooted, [KEY, "pid"])


def render_forest(forest: DataFrame) -> DataFrame:
    """One text line per process; sorted by (session, path) it reads as a tree.

    Lines stay rows: a session may have any number of processes.
    """
    text = F.concat(
        F.repeat(F.lit("  "), F.col("depth")),
        F.col("process_name"),
        *[
            part
            for label, name in (
                (" [pid: ", "pid"), (", events: ", "events"), (", files: ", "files"),
                (", net: ", "net"), (", crypto: ", "crypto"),
            )
            for part in (F.lit(label), F.col(name).cast("string"))
        ],
        F.lit("]"),
        F.when(
            F.col("exit_code").isNotNull(),
            F.concat(F.lit(" (exit: "), F.col("exit_code").cast("string"), F.lit(")")),
        ).otherwise(""),
    )
    return forest.select(KEY, "path", text.alias("line"))
