"""Near-duplicate vectors by dual traversal of cover trees.

Vectors of one label (and length) are compared by cosine; on the unit sphere a cosine of at least c is
a distance of at most sqrt(2 - 2 c). Large labels are split into cells around chosen vectors, level by
level, until a cell holds at most ``cell_rows``; cells whose balls are too far apart for a
link are never brought together. For every other pair of cells one task builds a cover tree of
each: nested nets, each level with half the radius of the one above. Walking both trees at once, a
pair of nodes is dropped if even its nearest members are too far apart, and taken as a whole if
its farthest ones are near enough; what is left is compared exactly, in double precision.

Tasks return link counts and a spanning forest of the links, never the links themselves.
Equal vectors are one class with a count.

Defined results: a null label, and a null or zero vector or one with a null or non-finite component, link
with nothing; vectors of different length do not link; rows that repeat are vectors of their
own (a repeated vec_id gets a row each time); an empty table gives no rows; other columns are
not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrilake.llm.components import connected_components
from sentrilake.session import cut

COSINE = 0.93
CELL_ROWS = 4096
_CENTERS = 4
_LEAF = 24
#: Room for rounding in the bounds; the exact test has none.
_SLACK = 1e-7


class Points:
    """Raw vectors, their norms, unit vectors and weights of a task."""

    def __init__(self, raw: np.ndarray, weights: np.ndarray):
        self.raw, self.weights = raw, weights
        self.norms = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        self.unit = raw / self.norms[:, None]
        self.links = np.zeros(len(raw), np.int64)
        self.label = np.arange(len(raw))

    def cosine(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.raw[i] @ self.raw[j].T) / (self.norms[i][:, None] * self.norms[j][None, :])

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.unit[i] @ self.unit[j].T)))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Union of the trees of i[k] and j[k] for every k."""
        while True:
            apart = self.label[i] != self.label[j]
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            a, b = sorted((self.label[i[0]], self.label[j[0]]))
            self.label[self.label == b] = a

    def link(self, i: np.ndarray, j: np.ndarray, same: bool) -> None:
        """Compare two groups of points exactly. ``same``: the groups are one, pairs count once."""
        near = self.cosine(i, j) >= self.threshold
        if same:
            near &= np.tri(len(i), dtype=bool).T
            np.fill_diagonal(near, False)
        if near.any():
            self.links[i] += near @ self.weights[j]
            self.links[j] += self.weights[i] @ near
            a, b = np.nonzero(near)
            self.join(i[a], j[b])

    def link_all(self, i: np.ndarray, j: np.ndarray) -> None:
        """Every pair of two disjoint groups is a link."""
        self.links[i] += self.weights[j].sum()
        self.links[j] += self.weights[i].sum()
        self.join(i, np.full(len(i), j[0]))
        self.join(j, np.full(len(j), i[0]))

    threshold = COSINE


class Node:
    """Members within ``radius`` of ``center``. Children cover them with half the radius."""

    __slots__ = ("center", "radius", "members", "children")

    def __init__(self, points: Points, members: np.ndarray, center: int, away: np.ndarray):
        self.center, self.members, self.radius = center, members, float(away.max(initial=0.0))
        self.children: list[Node] = []
        if len(members) <= _LEAF or self.radius < 1e-6:
            return
        # Farthest-first: the centre stays a centre below (nesting); each new one is farther than half
        # the radius from all others (separation), until everything is covered.
        owner, nearest = np.zeros(len(members), np.int64), away.copy()
        centers = [center]
        while (far := int(nearest.argmax())) is not None and nearest[far] > self.radius / 2:
            centers.append(int(members[far]))
            d = points.distance(members[far : far + 1], members)[0]
            d[far] = 0.0
            closer = d < nearest
            owner[closer], nearest[closer] = len(centers) - 1, d[closer]
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(centers) + 1))
        for c, a, b in zip(centers, starts[:-1], starts[1:]):
            part = order[a:b]
            self.children.append(Node(points, members[part], c, nearest[part]))


def build(points: Points, members: np.ndarray) -> Node:
    return Node(points, members, int(members[0]), points.distance(members[:1], members)[0])


def traverse(points: Points, a: Node, b: Node, reach: float) -> None:
    """Find all links between the members of two nodes (or within one, if they are the same)."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if not a.children and not b.children:
            points.link(a.members, b.members, a is b)
            continue
        if a is b:
            left = right = a.children
        else:
            left, right = a.children or [a], b.children or [b]
        bounds = np.array([x.radius for x in left])[:, None] + np.array([x.radius for x in right])[None, :]
        apart = points.distance(np.array([x.center for x in left]), np.array([x.center for x in right]))
        open_ = apart - bounds <= reach + _SLACK
        whole = apart + bounds <= reach - _SLACK
        if a is b:
            open_ &= np.tri(len(left), dtype=bool).T
            np.fill_diagonal(whole, False)
        single = np.array([len(x.members) == 1 for x in left])[:, None] & np.array([len(x.members) == 1 for x in right])[None, :]
        if a is b:
            np.fill_diagonal(single, False)
            np.fill_diagonal(open_, [len(x.members) > 1 for x in left])
        _link_singles(points, left, right, open_ & single)
        for i, j in zip(*np.nonzero(open_ & ~single)):
            if whole[i, j]:
                points.link_all(left[i].members, right[j].members)
            else:
                todo.append((left[i], right[j]))


def _link_singles(points: Points, left: list[Node], right: list[Node], pairs: np.ndarray) -> None:
    i, j = np.nonzero(pairs)
    if not len(i):
        return
    i, j = np.array([x.center for x in left])[i], np.array([x.center for x in right])[j]
    near = np.einsum("ij,ij->i", points.raw[i], points.raw[j]) / (points.norms[i] * points.norms[j]) >= points.threshold
    i, j = i[near], j[near]
    np.add.at(points.links, i, points.weights[j])
    np.add.at(points.links, j, points.weights[i])
    points.join(i, j)


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cells(classes: DataFrame, cell_rows: int) -> DataFrame:
    """Adds ``cell`` and ``away`` (distance to its centre) and ``center``. A level splits every cell with too
    many rows around the vectors with the smallest hashes; splitting ends when no cell got smaller,
    as then its vectors are too near to one another to be told apart."""
    rows = classes.withColumn("cell", F.xxhash64("label", F.size("vector")))
    level = 0
    while True:
        counts = rows.groupBy("cell").agg(F.count("*").alias("n"))
        large = cut(counts.where(F.col("n") > cell_rows).select(F.col("cell").alias("large")))
        if large.isEmpty() or level == 40:
            break
        level += 1
        inside = rows.join(large, F.col("cell") == F.col("large"))
        place = F.row_number().over(Window.partitionBy("large").orderBy(F.xxhash64("node", F.lit(level)), "node"))
        centers = inside.select("large", "node", "vector").withColumn("place", place).where(F.col("place") <= _CENTERS)
        centers = cut(centers.groupBy(F.col("large").alias("split")).agg(F.sort_array(F.collect_list(F.struct("place", "vector"))).alias("centers")))
        found = inside.join(centers, F.col("large") == F.col("split")).select(
            "node", "label", "vector", "n", "cell", F.col("centers.vector").alias("centers"))
        moved = found.mapInArrow(_nearest, "node long, label int, vector array<double>, n long, cell long, near int")
        moved = moved.withColumn("cell", F.xxhash64("cell", "near")).drop("near")
        rest = rows.join(large, F.col("cell") == F.col("large"), "left_anti")
        rows = cut(rest.unionByName(moved))
    return rows


def _vectors(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _nearest(batches):
    for batch in batches:
        near = []
        for vector, centers in zip(_vectors(batch["vector"]) if batch.num_rows else [], batch["centers"].to_pylist()):
            c = np.array(centers)
            near.append(int(((c @ vector) / np.sqrt((c * c).sum(axis=1))).argmax()))
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in ("node", "label", "vector", "n", "cell")), pa.array(near, pa.int32())],
            ["node", "label", "vector", "n", "cell", "near"],
        )


def _unit(vector: str) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: x / norm)


def _apart(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))


def _cell_pairs(rows: DataFrame, reach: float) -> DataFrame:
    """Pairs of cells of a label whose balls are near enough: pair, a, b. Works on one row per cell."""
    center = rows.groupBy("cell").agg(F.min_by("vector", "node").alias("middle"))
    away = rows.join(center.withColumnRenamed("cell", "own"), F.col("cell") == F.col("own"))
    away = away.select("cell", "label", _unit("vector").alias("u"), _unit("middle").alias("m"))
    cells = cut(away.groupBy("cell").agg(F.first("label").alias("label"), F.first("m").alias("m"), F.size(F.first("m")).alias("size"),
                                         F.max(_apart("u", "m")).alias("radius")))
    a = cells.select(*[F.col(c).alias(f"a_{c}") for c in cells.columns])
    met = a.join(cells, (F.col("a_label") == F.col("label")) & (F.col("a_size") == F.col("size")) & (F.col("a_cell") <= F.col("cell")))
    near = (F.col("a_cell") == F.col("cell")) | (_apart("a_m", "m") <= F.col("a_radius") + F.col("radius") + reach + _SLACK)
    return cut(met.where(near).select(F.xxhash64("a_cell", "cell").alias("pair"), F.col("a_cell").alias("a"), F.col("cell").alias("b")))


def _compare(threshold: float):
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        nodes = table["node"].to_numpy()
        order = np.argsort(nodes)  # the same tree whatever order the rows came in
        table, side, nodes = table.take(pa.array(order)), side[order], nodes[order]
        points = Points(_vectors(table["vector"]), table["n"].to_numpy())
        points.threshold = threshold
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(right):
            traverse(points, build(points, left), build(points, right), reach)
        else:
            tree = build(points, left)
            traverse(points, tree, tree, reach)
        found = np.flatnonzero(points.links)
        return pa.table({"node": pa.array(nodes[found], pa.int64()), "links": pa.array(points.links[found], pa.int64()),
                         "to": pa.array(nodes[points.label[found]], pa.int64())})

    return compare


def link_vectors(vectors: DataFrame, threshold: float = COSINE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) to vec_id, n_links, component_id, kept."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                          F.col("embedding").cast("array<double>").alias("vector"))
    fit = F.col("label").isNotNull() & usable(F.col("vector"))
    rows = rows.withColumn("node", F.when(fit, F.xxhash64("label", "vector")))
    classes = cut(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("first_id")))
    celled = _cells(classes.drop("first_id"), cell_rows)
    pairs = _cell_pairs(celled, reach)
    wanted = ["pair", "node", "vector", "n"]
    left = celled.join(pairs, F.col("cell") == F.col("a")).select(*wanted, F.lit(0).alias("side"))
    right = celled.join(pairs.where("a != b"), F.col("cell") == F.col("b")).select(*wanted, F.lit(1).alias("side"))
    found = cut(left.unionByName(right).groupBy("pair").applyInArrow(_compare(threshold), "node long, links long, to long"))
    comps = connected_components(found.where("node != to").select("node", "to"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "n", "first_id").join(links, "node", "left").join(comps, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    names = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = known.join(names, "component").select(
        F.col("node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "node").join(named, F.col("node") == F.col("class"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
