"""Behaviour graph of a session: edges, counts, traversals.

Events are the nodes. Besides the explicit parent links there are four inferred
relations. All of them have one shape: events belong to *groups*, and inside a
group every entry with a smaller position leads to every entry with a larger one
(directly or through a chain).

===================  ==========================  =========================
relation             group                       position
===================  ==========================  =========================
TEMPORAL             process id                  place in time order
RESOURCE             file path                   place in time order
CAUSAL (DNS)         address                     place in time order
PROCESS_LINEAGE      child process id            0 for spawn, 1 for start
===================  ==========================  =========================

Counts and traversals work on the group memberships, whose size is linear in the
events. DNS and lineage edges, which pair up a whole group, are kept as spans by
:func:`edge_spans`; :func:`edges_into` lists those of given events, and only :func:`build_edges` all.

Input events need a unique ``event_id`` per session (see
``streaming.feed.drop_duplicate_events``) and ``ord``, the dense place in time
order (see ``ordering.deterministic_order``).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrilake.functions.fields import event_hash, payload, pid
from sentrilake.operators.ordering import BUCKET, adjacent_pairs, bucket_of
from sentrilake.session import cut

KEY = "artifact_id"
# Rounds of a traversal after which its small result tables are merged into one.
COMPACT_EVERY = 12
# Positions of a group whose hops into another group are kept as one.
HOP_BUCKET = 1024
_EDGE = ["artifact_id", "src", "dst", "kind"]


def explicit_edges(events: DataFrame) -> DataFrame:
    """PARENT and CAUSAL links as recorded; the source may be missing."""
    links = F.concat(
        F.when(
            F.col("parent_event_id").isNotNull(),
            F.array(F.struct(F.col("parent_event_id").alias("src"), F.lit("PARENT").alias("kind"))),
        ).otherwise(F.array().cast("array<struct<src:string,kind:string>>")),
        F.transform(
            F.coalesce("causal_parent_ids", F.array().cast("array<string>")),
            lambda parent: F.struct(parent.alias("src"), F.lit("CAUSAL").alias("kind")),
        ),
    )
    return events.select(KEY, F.col("event_id").alias("dst"), F.inline(links)).select(*_EDGE)


def _resource_path() -> Column:
    return F.when(F.col("event_type") == "FileOpen", payload("normalized_path")).when(
        F.col("event_type").isin("FileRead", "FileWrite"), payload("path")
    )


def temporal_edges(events: DataFrame) -> DataFrame:
    """Consecutive events of a process."""
    rows = events.select(KEY, pid().alias("pid"), "event_id", "ord")
    return adjacent_pairs(rows, [KEY, "pid"], "event_id").select(
        KEY, "src", "dst", F.lit("TEMPORAL").alias("kind")
    )


def resource_edges(events: DataFrame) -> DataFrame:
    """Consecutive events on a file path."""
    rows = events.select(KEY, _resource_path().alias("path"), "event_id", "ord").filter(
        F.col("path").isNotNull()
    )
    return adjacent_pairs(rows, [KEY, "path"], "event_id").select(
        KEY, "src", "dst", F.lit("RESOURCE").alias("kind")
    )


def dns_edges(events: DataFrame) -> DataFrame:
    """Each earlier DNS answer that holds the address of a connection."""
    answers = events.filter(F.col("event_type") == "DnsResponse").select(
        KEY, F.explode(payload("addresses")).alias("ip"), F.col("event_id").alias("src"),
        F.col("ord").alias("answered"),
    )
    connects = events.filter(F.col("event_type") == "NetworkConnect").select(
        KEY, payload("remote_address").alias("ip"), F.col("event_id").alias("dst"),
        F.col("ord").alias("connected"),
    )
    # A busy address is a skewed join, which adaptive execution splits on both sides.
    pairs = answers.join(connects, [KEY, "ip"]).filter(F.col("answered") < F.col("connected"))
    return pairs.select(KEY, "src", "dst", F.lit("CAUSAL").alias("kind"))


def lineage_edges(events: DataFrame, strict: bool = False) -> DataFrame:
    """Spawn to every start of a process with the child's id.

    Process ids are reused, so this can link too much. ``strict`` keeps only the
    first start after the spawn.
    """
    spawns = events.filter(F.col("event_type") == "ProcessSpawn").select(
        KEY, payload("child_pid").alias("pid"), F.col("event_id").alias("src"),
        F.col("ord").alias("spawned"),
    )
    starts = events.filter(F.col("event_type") == "ProcessStart").select(
        KEY, pid().alias("pid"), F.col("event_id").alias("dst"), F.col("ord").alias("started")
    )
    if not strict:
        pairs = spawns.join(starts, [KEY, "pid"])
    else:
        pairs = _next_start(spawns, starts)
    return pairs.select(KEY, "src", "dst", F.lit("PROCESS_LINEAGE").alias("kind"))


def _next_start(spawns: DataFrame, starts: DataFrame, size: int = BUCKET) -> DataFrame:
    """For each spawn the nearest later start of the same process id.

    An as-of join without pairing: both sides are stacked and every spawn takes
    the next start in its bucket, or else the first start of a later bucket.
    """
    both = spawns.select(
        KEY, "pid", F.col("spawned").alias("at"), "src", F.lit(None).cast("string").alias("dst")
    ).unionByName(
        starts.select(
            KEY, "pid", F.col("started").alias("at"), F.lit(None).cast("string").alias("src"), "dst"
        )
    ).withColumn("_b", bucket_of(F.col("at"), size))
    firsts = both.groupBy(KEY, "pid", "_b").agg(
        F.min_by("dst", F.when(F.col("dst").isNotNull(), F.col("at"))).alias("_first")
    )
    later = W.partitionBy(KEY, "pid").orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    after = firsts.withColumn("_after", F.first("_first", ignorenulls=True).over(later))
    inner = W.partitionBy(KEY, "pid", "_b").orderBy("at").rowsBetween(1, W.unboundedFollowing)
    return (
        both.withColumn("_next", F.first("dst", ignorenulls=True).over(inner))
        .filter(F.col("src").isNotNull())
        .join(after.drop("_first"), [KEY, "pid", "_b"])
        .withColumn("dst", F.coalesce("_next", "_after"))
        .filter(F.col("dst").isNotNull())
    )


def build_edges(events: DataFrame, strict_lineage: bool = False) -> DataFrame:
    """All edges, one row each, weight 1. Repeated edges are kept."""
    return (
        explicit_edges(events)
        .unionByName(temporal_edges(events))
        .unionByName(resource_edges(events))
        .unionByName(dns_edges(events))
        .unionByName(lineage_edges(events, strict_lineage))
        .withColumn("weight", F.lit(1))
    )


def edge_spans(events: DataFrame, size: int = BUCKET) -> DataFrame:
    """DNS and lineage edges as spans: (session, kind, name, dst, sources).

    The sources of a group are numbered in the order of their positions, and an event's edges come from a first part of
    them, so one row with their number stands for all its edges in the group. The numbers are prefix sums over buckets
    of positions; the rows are linear in the events however many pairs a group has.
    """
    members = memberships(events).filter(F.col("kind").isin("DNS", "LINEAGE") & F.col("name").isNotNull())
    members = members.withColumn("_b", bucket_of(F.col("pos"), size))
    group = [KEY, "kind", "name"]
    is_src = F.col("is_src").cast("long")
    totals = members.groupBy(*group, "_b").agg(F.sum(is_src).alias("_n"))
    earlier = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    # All starts of a process id share a position, and so do all spawns: one row of counts each, not a window over them.
    inner = W.partitionBy(*group, "_b").orderBy("pos").rangeBetween(W.unboundedPreceding, -1)
    places = members.groupBy(*group, "_b", "pos").agg(F.sum(is_src).alias("_n"))
    places = places.withColumn("_inside", F.coalesce(F.sum("_n").over(inner), F.lit(0))).drop("_n")
    counted = places.join(before, [*group, "_b"]).select(*group, "pos", (F.col("_before") + F.col("_inside")).alias("sources"))
    targets = members.filter("is_dst").select(*group, "pos", F.col("event_id").alias("dst"))
    return targets.join(counted.filter("sources > 0"), [*group, "pos"]).select(*group, "dst", "sources")


def edges_into(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """The edges that lead to the ``wanted`` events (artifact_id, event_id), without listing any other pairs.

    Of chains only those of wanted events are read in order; of pairing groups only the wanted events meet their sources, so the
    output is linear in the spans of the wanted events.
    """
    wanted = wanted.select(KEY, F.col("event_id").alias("dst")).distinct()
    explicit = explicit_edges(events).join(wanted, [KEY, "dst"], "left_semi")
    chained = events.select(KEY, "event_id", "ord", F.inline(F.array(
        F.struct(F.lit("TEMPORAL").alias("kind"), pid().cast("string").alias("name")),
        F.struct(F.lit("RESOURCE").alias("kind"), _resource_path().alias("name")),
    ))).filter((F.col("kind") == "TEMPORAL") | F.col("name").isNotNull())
    # Only the chains that a wanted event is on are sorted; a null name is a chain of its own.
    on = chained.join(wanted.withColumnRenamed("dst", "event_id"), [KEY, "event_id"], "left_semi").select(
        F.col(KEY).alias("_key"), F.col("kind").alias("_kind"), F.col("name").alias("_name")).distinct()
    same = (F.col(KEY) == F.col("_key")) & (F.col("kind") == F.col("_kind")) & F.col("name").eqNullSafe(F.col("_name"))
    chains = adjacent_pairs(chained.join(on, same, "left_semi"), [KEY, "kind", "name"], "event_id").join(
        wanted, [KEY, "dst"], "left_semi")
    members = memberships(events).filter(F.col("kind").isin("DNS", "LINEAGE"))
    group = [KEY, "kind", "name"]
    into = members.filter("is_dst").withColumnRenamed("event_id", "dst").join(wanted, [KEY, "dst"]).select(
        *group, "dst", F.col("pos").alias("at"))
    from_ = members.filter("is_src").select(*group, F.col("event_id").alias("src"), "pos")
    pairs = into.join(from_, group).filter(F.col("pos") < F.col("at")).select(
        KEY, "src", "dst", F.when(F.col("kind") == "DNS", "CAUSAL").otherwise("PROCESS_LINEAGE").alias("kind"))
    edges = explicit.select(*_EDGE).unionByName(chains.select(*_EDGE)).unionByName(pairs)
    return edges.withColumn("weight", F.lit(1))


def add_edge(edges: DataFrame, extra: DataFrame, events: DataFrame) -> DataFrame:
    """Add hand-made edges whose two ends exist."""
    nodes = events.select(KEY, F.col("event_id").alias("_id"))
    known = (
        extra.join(nodes.withColumnRenamed("_id", "src"), [KEY, "src"], "left_semi")
        .join(nodes.withColumnRenamed("_id", "dst"), [KEY, "dst"], "left_semi")
        .select(*_EDGE)
        .withColumn("weight", F.lit(1))
    )
    return edges.unionByName(known)


def memberships(events: DataFrame) -> DataFrame:
    """(session, kind, name, pos, is_src, is_dst, event_id): groups of each event."""

    def member(kind: str, name: Column, pos: Column, src: bool, dst: bool) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), name.cast("string").alias("name"), pos.alias("pos"),
            F.lit(src).alias("is_src"), F.lit(dst).alias("is_dst"),
        )

    kind, place = F.col("event_type"), F.col("ord")
    path = _resource_path()
    single = F.array_compact(
        F.array(
            member("TEMPORAL", pid(), place, True, True),
            F.when(path.isNotNull(), member("RESOURCE", path, place, True, True)),
            F.when(
                kind == "NetworkConnect",
                member("DNS", payload("remote_address"), place, False, True),
            ),
            F.when(
                kind == "ProcessSpawn",
                member("LINEAGE", payload("child_pid"), F.lit(0).cast("long"), True, False),
            ),
            F.when(
                kind == "ProcessStart", member("LINEAGE", pid(), F.lit(1).cast("long"), False, True)
            ),
        )
    )
    answers = F.when(
        kind == "DnsResponse",
        F.transform(payload("addresses"), lambda ip: member("DNS", ip, place, True, False)),
    )
    groups = F.when(answers.isNull(), single).otherwise(F.concat(single, answers))
    return events.select(KEY, "event_id", F.inline(groups))


def graph_counts(events: DataFrame, size: int = BUCKET) -> DataFrame:
    """Nodes and edges per session, dangling edges included.

    Edges of a group are counted, not listed. Members are first counted per
    bucket of positions. A chain then has one edge less than members. A pairing
    group has (targets of a bucket) x (sources of earlier buckets) edges, plus
    the pairs inside each bucket.
    """
    links = F.col("parent_event_id").isNotNull().cast("long") + F.coalesce(
        F.size("causal_parent_ids"), F.lit(0)
    )
    base = events.groupBy(KEY).agg(F.count("*").alias("nodes"), F.sum(links).alias("n"))
    group = [KEY, "kind", "name"]
    is_src, is_dst = F.col("is_src").cast("long"), F.col("is_dst").cast("long")
    members = memberships(events).withColumn("_b", bucket_of(F.col("pos"), size))
    totals = members.groupBy(*group, "_b").agg(
        F.count("*").alias("m"), F.sum(is_src).alias("s"), F.sum(is_dst).alias("d")
    )
    by_bucket = W.partitionBy(*group).orderBy("_b")
    earlier = F.coalesce(F.sum("s").over(by_bucket.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = (F.row_number().over(by_bucket) == 1).cast("long")
    # Lineage uses the positions 0 and 1 only, so its groups have one bucket.
    per_bucket = (
        F.when(F.col("kind").isin("TEMPORAL", "RESOURCE"), F.col("m") - first)
        .when(F.col("kind") == "LINEAGE", F.col("s") * F.col("d"))
        .otherwise(F.col("d") * earlier)
    )
    inner = W.partitionBy(*group, "_b").orderBy("pos").rangeBetween(W.unboundedPreceding, -1)
    inside = (
        members.filter(F.col("kind") == "DNS")
        .withColumn("n", F.coalesce(F.sum(is_src).over(inner), F.lit(0)))
        .filter("is_dst")
    )
    edges = (
        totals.withColumn("n", per_bucket)
        .select(KEY, "n")
        .unionByName(inside.select(KEY, "n"))
        .groupBy(KEY)
        .agg(F.sum("n").alias("inferred"))
    )
    return base.join(edges, KEY, "left").select(
        KEY, "nodes", (F.col("n") + F.coalesce("inferred", F.lit(0))).cast("long").alias("edges")
    )


def graph_hash(events: DataFrame) -> DataFrame:
    """Digest of each session's graph, the same for any order of its rows.

    The ordered chain of all hashes would pass a session through one task. Each
    event hash is tied to its place and its group memberships (they determine
    the inferred edges) and its explicit links, and the digests are summed in
    four 60-bit lanes, which partial aggregation can do.
    """
    nodes = events.select(
        KEY,
        F.sha2(
            F.concat_ws(
                "|",
                F.lit("node"), F.col("ord").cast("string"), event_hash(),
                F.coalesce("parent_event_id", F.lit("")),
                F.array_join(F.coalesce("causal_parent_ids", F.array().cast("array<string>")), ","),
            ),
            256,
        ).alias("h"),
    )
    links = memberships(events).select(
        KEY,
        F.sha2(
            F.concat_ws("|", F.lit("link"), "kind", "name", F.col("pos").cast("string"), "event_id"),
            256,
        ).alias("h"),
    )
    lanes = [
        F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"_{i}")
        for i in range(4)
    ]
    return (
        nodes.unionByName(links)
        .groupBy(KEY)
        .agg(*lanes)
        .select(
            KEY,
            F.sha2(
                F.concat_ws("|", *[F.col(f"_{i}").cast("string") for i in range(4)]), 256
            ).alias("graph_hash"),
        )
    )


def link_members(events: DataFrame) -> DataFrame:
    """The recorded links as groups like the others: that of an event holds its parents at position 0 and the event
    at 1. Parents that are not in the session are left out."""
    links = explicit_edges(events).select(KEY, "src", "dst").distinct()
    known = links.join(events.select(KEY, F.col("event_id").alias("src")), [KEY, "src"], "left_semi")
    ends = F.array(
        F.struct(F.lit(0).cast("long").alias("pos"), F.lit(True).alias("is_src"), F.lit(False).alias("is_dst"), F.col("src").alias("event_id")),
        F.struct(F.lit(1).cast("long").alias("pos"), F.lit(False).alias("is_src"), F.lit(True).alias("is_dst"), F.col("dst").alias("event_id")),
    )
    return known.select(KEY, F.lit("LINK").alias("kind"), F.col("dst").alias("name"), F.inline(ends)).distinct()


def _reach(events: DataFrame, seeds: DataFrame, backward: bool, size: int) -> DataFrame:
    """(session, seed_id, event_id) reachable from each seed, the seed excluded.

    Reaching a group at position p reaches every source before p (or every target after p, forward), so
    what is reached of a group is one number, its mark. An event reached in one group enters the others it belongs
    to: that is a hop. Of all hops from a bucket of positions into a group only the farthest moves its mark, so the
    hops of whole buckets are kept as one row each, and single hops are read only in the buckets where the newly reached
    span begins and ends. A round reads those rows for the groups whose marks moved and writes the marks that move next;
    events are listed once, from the final marks. A chain of any length takes one round.
    """
    events = events.join(seeds.select(KEY).distinct(), KEY, "left_semi")
    members = cut(memberships(events).unionByName(link_members(events)))
    enter, leave = ("is_dst", "is_src") if backward else ("is_src", "is_dst")
    best = F.max if backward else F.min
    near, far = [KEY, "kind", "name"], [KEY, "to_kind", "to_name"]
    inlets = members.filter(enter).select(
        KEY, "event_id", F.col("kind").alias("to_kind"), F.col("name").alias("to_name"), F.col("pos").alias("to_pos"))
    hops = cut(
        members.filter(leave).join(inlets, [KEY, "event_id"])
        .filter((F.col("kind") != F.col("to_kind")) | (F.col("name") != F.col("to_name")))
        .select(*near, "pos", bucket_of(F.col("pos"), size).alias("bucket"), *far[1:], "to_pos")
    )
    # No span holds the whole of a group's last bucket (first, forward), so most groups have no such rows.
    edge = hops.groupBy(*near).agg(best("bucket").alias("_edge"))
    whole = cut(
        hops.groupBy(*near, "bucket", *far[1:]).agg(best("to_pos").alias("to_pos"))
        .join(edge, near).filter(F.col("bucket") != F.col("_edge")).drop("_edge")
    )
    start = seeds.select(KEY, F.col("event_id").alias("seed_id"), "event_id").distinct()
    moved = cut(
        start.join(members.filter(enter), [KEY, "event_id"]).groupBy(*near, "seed_id").agg(best("pos").alias("mark"))
        .withColumn("old", F.lit(None).cast("long"))
    )
    marks = moved.drop("old")
    for turn in count(1):
        mark, old, bucket = F.col("mark"), F.col("old"), F.col("bucket")
        first, last = bucket_of(mark, size), bucket_of(old, size)
        if backward:
            span = (F.col("pos") < mark) & (old.isNull() | (F.col("pos") >= old))
            inner = (bucket < first) & (old.isNull() | (bucket > last))
        else:
            span = (F.col("pos") > mark) & (old.isNull() | (F.col("pos") <= old))
            inner = (bucket > first) & (old.isNull() | (bucket < last))
        # The buckets at the ends of the span; a bucket that is both is read once.
        ends = F.array_compact(F.array_distinct(F.array(first, last)))
        rims = moved.withColumn("bucket", F.explode(ends))
        by_rim = rims.join(hops, [*near, "bucket"]).filter(span).select("seed_id", *far, "to_pos")
        by_bucket = moved.join(whole, near).filter(inner).select("seed_id", *far, "to_pos")
        touched = by_rim.unionByName(by_bucket).groupBy("seed_id", *far).agg(best("to_pos").alias("mark"))
        touched = touched.withColumnsRenamed({"to_kind": "kind", "to_name": "name"})
        known = marks.groupBy(*near, "seed_id").agg(best("mark").alias("old"))
        farther = F.col("mark") > F.col("old") if backward else F.col("mark") < F.col("old")
        seen = Observation()
        moved = cut(
            touched.join(known, [*near, "seed_id"], "left").filter(F.col("old").isNull() | farther)
            .select(*near, "seed_id", "mark", "old").observe(seen, F.count(F.lit(1)).alias("n"))
        )
        if not seen.get["n"]:
            break
        marks = marks.unionByName(moved.drop("old"))
        if turn % COMPACT_EVERY == 0:
            marks = cut(marks.groupBy(*near, "seed_id").agg(best("mark").alias("mark")))
    final = marks.groupBy(*near, "seed_id").agg(best("mark").alias("mark"))
    within = F.col("pos") < F.col("mark") if backward else F.col("pos") > F.col("mark")
    found = members.filter(leave).join(final, near).filter(within).select(KEY, "seed_id", "event_id")
    return found.distinct().filter(F.col("seed_id") != F.col("event_id"))


def ancestors(events: DataFrame, seeds: DataFrame, size: int = HOP_BUCKET) -> DataFrame:
    """Everything that leads to each seed (columns artifact_id, event_id)."""
    return _reach(events, seeds, True, size)


def descendants(events: DataFrame, seeds: DataFrame, size: int = HOP_BUCKET) -> DataFrame:
    """Everything each seed leads to."""
    return _reach(events, seeds, False, size)


def causal_neighborhood(events: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Events within ``depth`` steps over CAUSAL and PARENT links, either way.

    Links through missing events count; the missing events are not returned.
    """
    events = events.join(seeds.select(KEY).distinct(), KEY, "left_semi")
    dns = cut(memberships(events).filter(F.col("kind") == "DNS"))
    group = [KEY, "name"]
    links = explicit_edges(events).select(KEY, "src", "dst")
    links = cut(
        links.select(KEY, F.col("src").alias("event_id"), F.col("dst").alias("to_id"))
        .unionByName(links.select(KEY, F.col("dst").alias("event_id"), F.col("src").alias("to_id")))
        .distinct()
    )
    row = [KEY, "seed_id", "event_id"]
    visited = frontier = cut(
        seeds.select(KEY, F.col("event_id").alias("seed_id"), "event_id").distinct()
    )
    for _ in range(depth):
        by_link = frontier.join(links, [KEY, "event_id"]).select(
            KEY, "seed_id", F.col("to_id").alias("event_id")
        )
        # One step into a DNS group: answers before the latest connection that
        # was reached, connections after the earliest answer that was reached.
        inside = (
            frontier.join(dns, [KEY, "event_id"])
            .groupBy(*group, "seed_id")
            .agg(
                F.max(F.when(F.col("is_dst"), F.col("pos"))).alias("last_connect"),
                F.min(F.when(F.col("is_src"), F.col("pos"))).alias("first_answer"),
            )
        )
        step = (F.col("is_src") & (F.col("pos") < F.col("last_connect"))) | (
            F.col("is_dst") & (F.col("pos") > F.col("first_answer"))
        )
        by_group = inside.join(dns, group).filter(step).select(*row)
        reached = by_link.unionByName(by_group).distinct().join(visited, row, "left_anti")
        seen = Observation()
        frontier = cut(reached.observe(seen, F.count(F.lit(1)).alias("n")))
        if not seen.get["n"]:
            break
        visited = visited.unionByName(frontier)
    return visited.filter(F.col("seed_id") != F.col("event_id")).join(
        events.select(KEY, "event_id"), [KEY, "event_id"], "left_semi"
    )
