"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrilake.llm import (
    alignment, covertree, hard_negatives, jaccard, language, linkgraph, mixing, packing, quality, templates, token_store, transducer, warc,
)
from sentrilake.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_store(token_store.write_store(table(spark, sf_dir, "documents")))


def compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge_quality(table(spark, sf_dir, "documents"))
    return found.drop("ratio", "odd_chunks")


def link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge_urls(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def language_model(docs: DataFrame) -> language.Model:
    """Learned from the documents that are not held out."""
    return language.train(docs.where(~held_out()))


def crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict_language(docs, language_model(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.link_vectors(table(spark, sf_dir, "embeddings"))


def warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.archive_pages(table(spark, sf_dir, "pages")))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.take_blocks(table(spark, sf_dir, "documents"))


def license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.scan_licenses(table(spark, sf_dir, "documents"))


def galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


def negatives_l2ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256).cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(finite)
    return hard_negatives.mine_negatives(hard_negatives.participants(rows, vec_id, moved, scaled), F.col("vec_id") % 100 == 0)


def bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transducer.decode_documents(transducer.encode_documents(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": ngram_jaccard,
    "op2_token_ids": token_ids,
    "op3_compression_bands": compression_bands,
    "op4_link_trust": link_trust,
    "op5_crf_language": crf_language,
    "op6_best_fit_packing": best_fit_packing,
    "op7_cover_tree": cover_tree,
    "op8_warc_normaliser": warc_normaliser,
    "op9_source_mixing": source_mixing,
    "op10_license_templates": license_templates,
    "op11_galloping_alignment": galloping_alignment,
    "op12_hard_negatives": negatives_l2ap,
    "op13_bpe_transducer": bpe_transducer,
}

#: SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op12_hard_negatives": """WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 10""",
    "op8_warc_normaliser": """WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT body, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY body)
SELECT page_id, n AS payload_bytes, sha256(p.body) AS payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON g.body = p.body AND p.n >= 100""",
}
