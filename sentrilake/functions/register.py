"""SQL functions of the library, callable from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

_COSINE = (
    "CASE WHEN size(a) <> size(b) THEN 0D ELSE least(1D, greatest(0D, aggregate("
    "zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v))) END"
)
_TAIL = r"substring_index(translate(p, '\\', '/'), '/', -1)"
_NAME = f"CASE WHEN p = '' THEN 'unknown' WHEN {_TAIL} = '' THEN p ELSE {_TAIL} END"


def register_functions(spark: SparkSession) -> None:
    """Create the session's SQL functions; all bodies are SQL, none is Python."""
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{create} canonical_process_name(p STRING) RETURNS STRING RETURN {_NAME}")
    spark.sql(
        f"{create} text_entropy(t STRING) RETURNS DOUBLE RETURN CASE WHEN t = '' THEN 0D ELSE "
        "aggregate(array_distinct(split(rtrim(regexp_replace(hex(t), '(..)', '$1 ')), ' ')), 0D, "
        "(s, b) -> s - (regexp_count(regexp_replace(hex(t), '(..)', '$1 '), b || ' ') "
        "/ octet_length(t)) * log2(regexp_count(regexp_replace(hex(t), '(..)', '$1 '), b || ' ') "
        "/ octet_length(t))) END"
    )
    spark.sql(
        f"{create} domain_entropy(d STRING) RETURNS DOUBLE "
        "RETURN text_entropy(substring_index(d, '.', 1))"
    )
    spark.sql(
        f"{create} label_is_dga(l STRING) RETURNS BOOLEAN RETURN octet_length(l) >= 8 AND ("
        "(text_entropy(l) > 3.65 AND length(regexp_replace(l, '[^aeiou]', '')) / octet_length(l) < 0.18) "
        "OR (length(regexp_replace(l, '[^0-9]', '')) > 5 AND text_entropy(l) > 3.2) "
        r"OR (length(regexp_replace(l, '[^\\p{IsAlphabetic}]', '')) "
        "- length(regexp_replace(l, '[^aeiou]', '')) > 9 "
        "AND length(regexp_replace(l, '[^aeiou]', '')) <= 1))"
    )
    spark.sql(
        f"{create} is_likely_dga(d STRING) RETURNS BOOLEAN "
        "RETURN label_is_dga(lower(substring_index(d, '.', 1)))"
    )
    spark.sql(
        f"{create} cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {_COSINE}"
    )
