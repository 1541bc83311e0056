"""Event tables and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrilake.functions.fields import utc_day
from sentrilake.operators.ordering import deterministic_order
from sentrilake.schema import EVENTS, RECORD

CORRUPT = "_corrupt"
_JSON_SCHEMA = T.StructType(
    [T.StructField("artifact_id", T.StringType()), T.StructField("host_id", T.StringType())]
    + RECORD.fields
    + [T.StructField(CORRUPT, T.StringType())]
)


def _session_name() -> Column:
    """File name without its extension."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def _is_bad() -> Column:
    return F.col(CORRUPT).isNotNull() | F.col("event_id").isNull()


def read_raw_events(spark: SparkSession, path: str, form: str = "ndjson") -> DataFrame:
    """JSON records with the fixed schema and their ``_file``; bad ones keep their text in ``_corrupt``."""
    reader = (
        spark.read.schema(_JSON_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreCorruptFiles", False)
        .option("multiLine", form == "json")
    )
    return reader.json(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), _session_name().alias("_name")
    ).withColumn("artifact_id", F.coalesce("artifact_id", "_name")).drop("_name")


def read_rejects(spark: SparkSession, path: str, form: str = "ndjson") -> DataFrame:
    """The records that ``read_events`` does not accept: artifact_id, file, reason, record."""
    reason = F.when(F.col(CORRUPT).isNotNull(), "not an event record").otherwise("no event_id")
    return read_raw_events(spark, path, form).filter(_is_bad()).select(
        "artifact_id", F.col("_file").alias("file"), reason.alias("reason"),
        F.col(CORRUPT).alias("record"),
    )


def rejected_sessions(spark: SparkSession, path: str, form: str = "ndjson") -> DataFrame:
    """The sessions that have a record in a file with a rejected one: artifact_id, rejected records."""
    raw = read_raw_events(spark, path, form)
    files = raw.groupBy("_file").agg(F.count_if(_is_bad()).alias("rejected")).filter("rejected > 0")
    parts = raw.groupBy("artifact_id", F.col("_file").alias("_of")).agg(F.count("*").alias("records"))
    found = parts.join(files, F.col("_of") == F.col("_file"))
    return found.groupBy("artifact_id").agg(F.sum("rejected").alias("rejected"))


def read_events(
    spark: SparkSession, path: str, form: str = "parquet", strict: bool = True
) -> DataFrame:
    """Event table from ``parquet``, ``ndjson`` or ``json`` (an array per file).

    A damaged file and a record that is no event fail the read. With ``strict`` off such
    records are left out; ``read_rejects`` lists them. Damaged files fail it all the same.
    ``seq`` follows the array position in the ``json`` form; there a file is read
    by one task, so the row id grows with the position. NDJSON files are split,
    so ``seq`` is the position in time order.
    """
    if form == "parquet":
        return spark.read.schema(EVENTS).option("ignoreCorruptFiles", False).parquet(path)
    raw = read_raw_events(spark, path, form)
    if strict:
        # One condition, below the numbering, so that no other filter can hide a bad record.
        failure = F.raise_error(F.concat(F.lit("record that is no event in "), "_file"))
        raw = raw.filter(F.when(_is_bad(), failure.cast("boolean")).otherwise(True))
    if form == "json":
        raw = raw.withColumn("seq", F.monotonically_increasing_id())
    events = (raw if strict else raw.filter(~_is_bad())).drop(CORRUPT, "_file")
    if form == "ndjson":
        events = deterministic_order(events, out="seq")
    return events.select(*[F.col(name) for name in EVENTS.fieldNames()])


def read_corpus(
    spark: SparkSession, path: str, form: str = "parquet", exclude: str | None = None
) -> DataFrame:
    """A folder of sessions; ``exclude`` is left out.

    In the text forms a session with a record in a file with rejected ones is left out whole;
    ``rejected_sessions`` lists them. A damaged Parquet or compressed file fails the read.
    """
    events = read_events(spark, path, form, strict=False)
    if form != "parquet":
        rejected = rejected_sessions(spark, path, form).select(F.col("artifact_id").alias("_left_out"))
        events = events.join(rejected, F.col("artifact_id") == F.col("_left_out"), "left_anti")
    return events if exclude is None else events.filter(F.col("artifact_id") != exclude)


def read_events_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """New NDJSON files of a folder as a stream, bad records kept in ``_corrupt``."""
    reader = (
        spark.readStream.schema(_JSON_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path).withColumn(
        "artifact_id", F.coalesce("artifact_id", _session_name())
    )


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Event table for later runs, laid out for pruning.

    The range on (session, position) splits a session of any size over many
    files and keeps the neighbours of an event together.
    """
    (
        events.withColumn("event_day", utc_day(F.col("timestamp_wall")))
        .repartitionByRange("event_day", "artifact_id", "seq")
        .sortWithinPartitions("event_day", "artifact_id", "seq")
        .write.mode(mode)
        .partitionBy("event_day")
        .parquet(path)
    )
