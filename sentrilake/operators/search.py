"""Behaviour vectors of sessions and similarity search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrilake.functions.fields import payload, process_name
from sentrilake.functions.vectors import cosine_similarity

# Event types of dimensions 0 to 18; all others share 19.
VECTOR_TYPES = [
    "ProcessStart", "ProcessExit", "ProcessSpawn", "FileOpen", "FileRead", "FileWrite",
    "FileDelete", "FileRename", "NetworkConnect", "NetworkAccept", "NetworkClose", "DnsQuery",
    "DnsResponse", "MemoryMap", "MemoryProtect", "CryptoOperation", "TlsObserved", "IpcConnect",
    "IpcSend",
]
DIMENSIONS = 32
# Query vectors that one scan of the corpus compares at once.
QUERIES_PER_PASS = 1_000


def behavior_vectors(events: DataFrame, key: str = "artifact_id") -> DataFrame:
    """A unit vector of 32 behaviour counts per session."""
    kind = F.col("event_type")
    facts = events.select(
        key,
        "event_type",
        F.when(kind.isin("FileOpen", "FileWrite"), payload("path")).alias("_path"),
        F.when(kind == "NetworkConnect", payload("remote_address")).alias("_ip"),
        process_name().alias("_name"),
    )
    # Distinct values are first folded per (session, type, path, address, name),
    # which spreads a large session over the cluster and shrinks its rows.
    folded = facts.groupBy(key, "event_type", "_path", "_ip", "_name").agg(
        F.count("*").alias("_n")
    )

    def events_where(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))

    counts = [events_where(kind == name) for name in VECTOR_TYPES]
    counts.append(events_where(~kind.isin(VECTOR_TYPES)))
    counts += [F.count_distinct(c) for c in ("_path", "_ip", "_name")]
    counts.append(F.sum("_n"))
    names = [f"_c{i}" for i in range(len(counts))]
    raw = folded.groupBy(key).agg(
        *[c.cast("double").alias(n) for c, n in zip(counts, names, strict=True)]
    )
    # Every session has events, so the length is positive.
    length = F.sqrt(reduce(lambda a, b: a + b, [F.col(n) * F.col(n) for n in names]))
    scaled = [F.col(n) / F.col("_length") for n in names]
    scaled += [F.lit(0.0)] * (DIMENSIONS - len(names))
    return raw.withColumn("_length", length).select(key, F.array(*scaled).alias("vector"))


def _label(similarity: Column) -> Column:
    return F.when(similarity >= 0.9, "HIGHLY SIMILAR (VARIANT)").otherwise("RELATED")


def search_similar(
    vectors: DataFrame, query_id: object, threshold: float = 0.75, key: str = "artifact_id"
) -> DataFrame:
    """Sessions at least as similar to one session as ``threshold``.

    The query vector is a scalar subquery, so the corpus is scanned once without
    a join. Sort by similarity for display.
    """
    query = vectors.filter(F.col(key) == F.lit(query_id)).select("vector").scalar()
    similarity = F.col("similarity")
    # As a generator the similarity is computed once, not again in the filter.
    score = F.array(cosine_similarity(F.col("vector"), F.col("_query")))
    return (
        vectors.filter(F.col(key) != F.lit(query_id))
        .withColumn("_query", query)
        .select(key, F.explode(F.filter(score, lambda s: s >= threshold)).alias("similarity"))
        .select(
            key,
            "similarity",
            F.format_string("%.2f%%", similarity * 100).alias("percent"),
            _label(similarity).alias("label"),
        )
    )


def search_similar_many(
    vectors: DataFrame, queries: DataFrame, threshold: float = 0.75, key: str = "artifact_id"
) -> DataFrame:
    """``search_similar`` for every session id in ``queries``.

    At most ``QUERIES_PER_PASS`` query vectors travel with one scan of the
    corpus, as a single array value; more queries take more scans. A corpus row
    only emits the queries it is similar to.
    """
    wanted = queries.select(key).distinct()
    chosen = vectors.join(wanted, key, "left_semi").select(F.struct(key, "vector").alias("q"))
    parts = []
    for batch in _batches(chosen, wanted.count()):
        table = batch.agg(F.collect_list("q").alias("qs")).scalar()
        scored = F.transform(
            "_table",
            lambda q: F.struct(
                q[key].alias("query_id"),
                F.when(q[key] != F.col(key), cosine_similarity(F.col("vector"), q["vector"])).alias(
                    "similarity"
                ),
            ),
        )
        kept = F.filter(scored, lambda s: s["similarity"] >= threshold)
        parts.append(vectors.withColumn("_table", table).select(key, F.inline(kept)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("label", _label(F.col("similarity")))


def _batches(chosen: DataFrame, count: int) -> Iterator[DataFrame]:
    passes = max(1, -(-count // (QUERIES_PER_PASS // 2)))
    if passes == 1:
        yield chosen
        return
    # Half-full batches on average leave room for uneven hashing.
    for i in range(passes):
        yield chosen.filter(F.pmod(F.xxhash64(F.to_json("q")), F.lit(passes)) == i)
