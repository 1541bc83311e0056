"""N-gram Jaccard join, heavy and light by set size.

A document is the set of its 64-bit shingle hashes. Equal sets are one node, named by a hash of the set.
Hashes are ordered from rare to frequent by a count sketch of fixed size; two similar sets share
hashes among the first few of both. Small sets enumerate the two-element subsets of those
first hashes and meet in a subset both have; large sets scan the inverted lists of single
hashes. The size where one way becomes cheaper than the other is the boundary.

Sets that meet are candidates. Listing all pairs of a list would grow with the square of a
group of near copies. So a list first compares its members with one of them, then with a few
more, and after every step those that are known to be connected are not compared again; the
rest is compared in full. No link between different components is lost. A candidate pair
is first tested by an upper bound from parity maps with at least a bit per hash, then exactly.

Defined results: a null text and one without words have an empty set, are linked with nothing
and are their own component; fewer words than a shingle are one shingle; repeated rows
are equal texts and get a row each; documents with a null doc_id take part, and their
component is the smallest doc_id in it or null; an empty table gives no rows. Other columns
are left out by ``join_documents`` and kept by ``keep_representatives``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrilake.llm.components import connected_components
from sentrilake.llm.scratch import Scratch
from sentrilake.llm.slices import slices, small_batches
from sentrilake.llm.worker import lean
from sentrilake.session import cut

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union. The prefix lengths below rest on it.
PERCENT = 80
SUBSET = 2
SKETCH_BITS = 20
_BLOCK = 1 << 14
#: Parity maps have this many bits, or more for larger sets: a power of two not below the set size.
_MAP_BITS = 1024
_FILTER_BITS = 23
#: Sets from this size on scan lists whatever the cost: their subsets are too many.
_LARGEST_SMALL = 256
#: Cost of a candidate pair, in rows of a list.
_PAIR_COST = 4.0
_MULT = np.uint64(0x9E3779B97F4A7C15)
_TASK_TEXTS = 500


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word sequences of a UTF-8 text."""
    from xxhash import xxh3_64_intdigest

    parts = data.lower().split()  # bytes: lower-cases ASCII only, splits at ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxh3_64_intdigest(b" ".join(parts), len(parts))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = out * _MULT + h[k : n + k]
    return np.unique(_mix(out))


def node_of(hashes: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def least_overlap(n: int) -> int:
    """Fewest common hashes of a set of n and any set similar to it."""
    return -(-PERCENT * n // 100)


def prefix_lengths(n: int, common: int = 1) -> tuple[int, int]:
    """First hashes of a set that share ``common`` hashes with those of any similar set: in all,
    and if the other set is not smaller."""
    not_smaller = -(-2 * PERCENT * n // (100 + PERCENT))
    return n - least_overlap(n) + common, n - not_smaller + common


def _sketch_place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def keys_of(hashes: np.ndarray, sketch: np.ndarray, boundary: int) -> np.ndarray:
    """Keys under which a set meets similar ones. The lowest bit is 1 for those that suffice if the
    other set is not smaller. Sets below the boundary enumerate subsets; those that may be
    similar to a set from the boundary on, or are one, give single hashes."""
    n = len(hashes)
    place = _sketch_place(hashes, sketch.size.bit_length() - 1)
    ordered = hashes[np.lexsort((hashes, sketch[place]))]
    out = []
    if n < boundary and least_overlap(n) >= SUBSET:
        every, short = prefix_lengths(n, SUBSET)
        first, second = np.array(list(combinations(range(min(every, n)), SUBSET)), np.int64).T
        key = _mix(ordered[first] * _MULT + _mix(ordered[second]))
        out.append((key & ~np.uint64(1)) | (second < short).astype(np.uint64))
    if n >= boundary * PERCENT / 100:
        every, short = prefix_lengths(n)
        out.append((ordered[:every] & ~np.uint64(1)) | (np.arange(every) < short).astype(np.uint64))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the number of hashes that fall to it, as 16 longs or, for sets of more than
    1024 hashes, 32, 64, ... The parts of a map, added bit by bit, are the map of fewer bits."""
    bits = max(_MAP_BITS, 1 << (len(hashes) - 1).bit_length())
    counts = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in slices(batch, rows=_TASK_TEXTS):
            yield part, [x or b"" for x in part["text"].cast(pa.binary()).to_pylist()]


def count_sketch(docs: DataFrame, scratch: Scratch, bits: int = SKETCH_BITS, words: int = WORDS) -> tuple[np.ndarray, DataFrame]:
    """How many documents have a hash that falls to each of 2**bits places, and a hash sample of
    the sets for the cost model: (token, n). The counts reach the driver as an array of fixed size; every
    task sends its own counts in blocks, which are added up block by block in a stream."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        tokens, sizes = [], []
        for _, texts in _texts(batches):
            for data in texts:
                hashes = shingles(data, words)
                np.add.at(counts, _sketch_place(hashes, bits), 1)
                if 0 < len(hashes) < _LARGEST_SMALL:
                    sampled = hashes[hashes % np.uint64(256) == 3]
                    tokens += sampled.view(np.int64).tolist()
                    sizes += [len(hashes)] * len(sampled)
        n = counts.size // _BLOCK
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([*range(n), -1], pa.int32()),
                "counts": pa.array([*(counts[i * _BLOCK : (i + 1) * _BLOCK].tobytes() for i in range(n)), None], pa.binary()),
                "tokens": pa.array([[]] * n + [tokens], pa.list_(pa.int64())),
                "sizes": pa.array([[]] * n + [sizes], pa.list_(pa.int32())),
            }
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["counts"].to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(data, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array(list(sums), pa.int32()), "counts": pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in sums.values()], pa.binary())}
        )

    rows = scratch.cut(docs.select("text").mapInArrow(lean(count), "block int, counts binary, tokens array<long>, sizes array<int>"))
    summed = rows.where("block >= 0").select("block", "counts").repartition("block").mapInArrow(lean(add), "block int, counts binary")
    out = np.zeros(1 << bits, np.int32)
    for block, data in summed.collect():
        out[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(data, np.int32)
    sample = rows.where("block = -1").select(F.explode(F.arrays_zip("tokens", "sizes")).alias("x"))
    return out, sample.select(F.col("x.tokens").alias("token"), F.col("x.sizes").alias("n"))


def choose_boundary(sample: DataFrame) -> int:
    """The boundary with the least cost, from the sampled hashes of sets below 256. A list costs a row per
    hash and the pairs it makes, by the mean list length of the rarer half of the hashes of sets of that size;
    subsets cost a row each, since sets that share one are mostly similar."""
    lists = sample.groupBy("token").agg(F.count("*").alias("length")).withColumnRenamed("token", "list_token")
    rows = sample.join(lists, F.col("token") == F.col("list_token"))
    lengths = rows.groupBy(F.log2("n").cast("int").alias("class"), "length").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("class").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    all_k = F.sum("k").over(Window.partitionBy("class"))
    rare = lengths.where("k > 0").withColumn("share", F.coalesce(F.sum("k").over(upto), F.lit(0)) / all_k).where("share <= 0.5")
    rare = rare.groupBy("class").agg((F.sum(F.col("length") * F.col("k")) / F.sum("k")).alias("length"))
    length = dict(rare.collect())  # one row per power of two below 256
    number = {n: k / n for n, k in sample.groupBy("n").count().collect()}  # at most 255 rows
    cost_list, cost_subset = np.zeros(_LARGEST_SMALL + 1), np.zeros(_LARGEST_SMALL + 1)
    for n in range(1, _LARGEST_SMALL):
        per_list = length.get(int(math.log2(n)), 1.0)
        cost_list[n] = number.get(n, 0) * prefix_lengths(n)[0] * (1 + _PAIR_COST * (per_list - 1))
        cost_subset[n] = number.get(n, 0) * math.comb(min(n, prefix_lengths(n, SUBSET)[0]), SUBSET)
    total = np.cumsum(cost_subset) - cost_subset + (cost_list.sum() - np.cumsum(cost_list) + cost_list)
    # Below 4 hashes only equal sets are similar; ties go to the subsets.
    return _LARGEST_SMALL - 1 - int(np.argmin(total[4:_LARGEST_SMALL][::-1]))


def encode_sets(docs: DataFrame, sketch: np.ndarray, boundary: int, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, node, keys, map of every row. Keys and map are given once per node and task."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # fixed size, see SKETCH_BITS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, texts in _texts(batches):
            sizes, nodes, keys, maps = [], [], [], []
            for data in texts:
                hashes = shingles(data, words)
                node = node_of(hashes) if len(hashes) else None
                new = node is not None and node not in seen
                seen.add(node)
                sizes.append(len(hashes))
                nodes.append(node)
                keys.append(keys_of(hashes, shared.value, boundary) if new else None)
                maps.append(parity_map(hashes) if new else None)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "node", "keys", "map"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(encode), "doc_id long, n_shingles long, node long, keys array<long>, map array<long>")


def _lists(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, node, n, short: members of the lists with at least two members, one of them short."""
    keyed = sets.where("keys IS NOT NULL").select("node", F.col("n_shingles").cast("int").alias("n"), F.explode("keys").alias("key"))
    rows = keyed.select(F.expr("key & -2L").alias("bucket"), "node", "n", (F.col("key").bitwiseAND(1) == 1).alias("short"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.max("short").alias("usable"))
    several = counts.where("members > 1 AND usable").select(F.col("bucket").alias("list"))
    # Copies that were dealt to several tasks are one member.
    found = rows.join(several, F.col("bucket") == F.col("list")).groupBy("bucket", "node").agg(
        F.first("n").alias("n"), F.max("short").alias("short"))
    return scratch.cut(found)


def _may_link(n: Column, m: Column) -> Column:
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def _folded(parity: Column, longs: Column) -> Column:
    """A parity map as one of ``longs`` longs."""
    def part(i: Column) -> Column:
        places = F.sequence(i, F.size(parity) - 1, longs)
        return F.aggregate(places, F.lit(0).cast("long"), lambda x, at: x.bitwiseXOR(F.get(parity, at)))

    return F.when(F.size(parity) == longs, parity).otherwise(F.transform(F.sequence(F.lit(0), longs - 1), part))


def _hub_pairs(lists: DataFrame, comps: DataFrame | None, hubs: int, scratch: Scratch) -> DataFrame:
    """Members of every list paired with ``hubs`` of its members, the same ones in as many lists as
    possible. Members known to be connected are not paired, and lists of one component drop out."""
    rows = lists
    if comps is not None:
        rows = _with_components(lists, comps, scratch)
    order = [F.min_by(F.struct("node", "n", *(["component"] if comps is not None else [])), F.xxhash64("node", F.lit(i + (0 if comps is None else 7)))) for i in range(hubs)]
    hub = rows.groupBy("bucket").agg(F.array(*order).alias("hubs")).select(F.col("bucket").alias("list"), F.explode("hubs").alias("hub"))
    differ = F.col("node") != F.col("hub.node")
    if comps is not None:
        differ = F.col("component") != F.col("hub.component")
    met = rows.join(hub, (F.col("bucket") == F.col("list")) & differ & _may_link(F.col("n"), F.col("hub.n")))
    return _ordered(met.select(F.col("node").alias("a"), F.col("hub.node").alias("b")))


def _with_components(lists: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """Members with their component, without the lists that lie in one component."""
    known = comps.withColumnRenamed("node", "member")
    rows = lists.join(known, F.col("node") == F.col("member"), "left").withColumn("component", F.coalesce("component", "node")).drop("member")
    rows = scratch.cut(rows)
    spread = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = spread.where("low != high").select(F.col("bucket").alias("open"))
    return rows.join(open_, F.col("bucket") == F.col("open")).drop("open")


def _rest_pairs(lists: DataFrame, comps: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """All pairs of a list whose members are not known to be connected. The parity maps are part of the
    join, so that it gives out only pairs that may be links. Every list of a set carries its map, so large
    sets take theirs folded to 1024 bits."""
    folded = nodes.select(F.col("node").alias("member"), _folded(F.col("map"), F.lit(_MAP_BITS // 64)).alias("map"))
    maps = folded.select("member", *[F.col("map")[i].alias(f"m{i}") for i in range(_MAP_BITS // 64)])
    rows = _with_components(lists, comps, scratch)
    rows = scratch.cut(rows.join(maps, F.col("node") == F.col("member")).drop("member"))
    left = rows.where("short").select(*[F.col(c).alias(f"l_{c}") for c in rows.columns])
    smaller = (F.col("l_n") < F.col("n")) | ((F.col("l_n") == F.col("n")) & (F.col("l_node") != F.col("node")))
    apart = sum(F.bit_count(F.col(f"l_m{i}").bitwiseXOR(F.col(f"m{i}"))) for i in range(_MAP_BITS // 64))
    common = F.floor((F.col("l_n") + F.col("n") - apart) / 2)
    met = left.join(rows, (F.col("l_bucket") == F.col("bucket")) & (F.col("l_component") != F.col("component"))
                    & smaller & _may_link(F.col("l_n"), F.col("n")) & _similar(F.col("l_n"), F.col("n"), common))
    return _ordered(met.select(F.col("l_node").alias("a"), F.col("node").alias("b")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that the parity maps allow: the sets differ in at least as many hashes as bits differ."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("map").alias("a_map"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("map").alias("b_map"))
    joined = pairs.join(a, "a").join(b, "b").withColumn("longs", F.least(F.size("a_map"), F.size("b_map")))
    a_map, b_map = _folded(F.col("a_map"), F.col("longs")), _folded(F.col("b_map"), F.col("longs"))
    apart = F.aggregate(F.zip_with(a_map, b_map, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    common = F.floor((F.col("a_n") + F.col("b_n") - apart) / 2)
    return joined.where(_similar(F.col("a_n"), F.col("b_n"), common)).select("a", "b", "a_n", "b_n")


def _similar(n: Column, m: Column, common: Column) -> Column:
    return 100 * common >= PERCENT * (n + m - common)


def _hash_filter(ids: DataFrame) -> np.ndarray:
    """One bit per id hash, of fixed size: what it lets pass is checked by a join."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _FILTER_BITS))
    words = ids.select(place.alias("p")).groupBy((F.col("p") / 64).cast("long").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits"))
    out = np.zeros((1 << _FILTER_BITS) // 64, np.int64)
    for w, bits in words.collect():  # at most 131072 rows
        out[w] = bits
    return out.view(np.uint8)


def _read_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The hashes of the wanted nodes (node). Texts are read again; a filter of fixed size keeps most others
    out before they are hashed."""
    ids = nodes.join(wanted, "node").select("doc_id", "node")
    bits = _hash_filter(ids)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch["place"].to_numpy()
            part = batch.filter(pa.array((shared.value[place >> 3] >> (place & 7) & 1).astype(bool)))
            for _, texts in _texts([part]):
                found = [shingles(x, words) for x in texts]
                found = [x for x in found if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))],
                    ["node", "hashes"],
                )

    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << _FILTER_BITS))
    rows = docs.select(place.alias("place"), "text").mapInArrow(lean(encode), "node long, hashes array<long>")
    return rows.join(wanted.withColumnRenamed("node", "wanted"), F.col("node") == F.col("wanted"), "left_semi").dropDuplicates(["node"])


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are links, by their full sets."""
    possible = scratch.cut(_possible(pairs, nodes))
    wanted = possible.select(F.col("a").alias("node")).union(possible.select("b")).distinct()
    sets = scratch.cut(_read_sets(docs, nodes, wanted, words))
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("a_hashes"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("b_hashes"))
    joined = possible.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("a_hashes", "b_hashes"))
    return joined.where(_similar(F.col("a_n"), F.col("b_n"), common)).select("a", "b")


def join_documents(docs: DataFrame, words: int = WORDS, sketch_bits: int = SKETCH_BITS,
                   boundary: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        with Scratch(docs.sparkSession) as counting:
            sketch, sample = count_sketch(docs, counting, sketch_bits, words)
            if boundary is None:
                boundary = choose_boundary(sample)
        sets = scratch.cut(encode_sets(docs, sketch, boundary, words))
        nodes = scratch.cut(sets.where("node IS NOT NULL").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("map", ignorenulls=True).alias("map")))
        lists = _lists(sets, scratch)
        members = scratch.cut(sets.select("doc_id", "n_shingles", "node"))
        scratch.drop(sets)
        links = comps = None
        for hubs in (1, 4, None):
            with Scratch(docs.sparkSession) as step:
                pairs = _rest_pairs(lists, comps, nodes, step) if hubs is None else _hub_pairs(lists, comps, hubs, step)
                found = scratch.cut(_verify(docs, nodes, pairs, words, step))
            links = found if links is None else links.unionByName(found)
            if comps is not None:
                scratch.drop(comps)
            comps = connected_components(links, scratch=scratch)
        # Components are named by nodes so far; their name is the smallest doc_id of any member.
        known = nodes.select("node", "doc_id").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        names = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = known.join(names, "component").select(F.col("node").alias("member"), "component_id")
        rows = members.join(named, F.col("node") == F.col("member"), "left")
        own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return cut(rows.select("doc_id", "n_shingles", own.alias("component_id")))


def keep_representatives(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns stay. Documents with an
    empty set or without a doc_id stay. Of equal rows with a group's smallest doc_id one stays."""
    found = join_documents(docs, words)
    kept = found.where(F.col("doc_id") == F.col("component_id"))
    kept = cut(kept.groupBy(F.col("doc_id").alias("kept_id")).agg(F.min(F.col("n_shingles")).alias("least")))
    own = docs.select(F.struct(*docs.columns).alias("doc"))  # their names cannot clash with those of ``kept``
    named = own.where("doc.doc_id IS NOT NULL").join(kept, F.col("doc.doc_id") == F.col("kept_id"))
    with_words = named.where("least > 0").select("doc.*").dropDuplicates(["doc_id", "text"])
    empty = named.where("least = 0").select("doc.*")
    return with_words.unionByName(empty).unionByName(docs.where("doc_id IS NULL"))
