"""Near-duplicate vectors by cover trees.

Vectors of a label are dealt into blocks of bounded size, cell by cell around a
few pivots. Each block becomes a cover tree on the unit sphere: nested levels of
centers whose radii halve from level to level, every node with the distance to
its farthest point. Pairs of blocks, and then pairs of nodes, are dropped when
the distance of their centers exceeds both radii and the threshold; what is left
at the leaves is compared exactly.
"""

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.components import connected_components
from tastegraph.session import materialise

THRESHOLD = 0.93
#: Vectors in a block, and pivots at most (a bound on what is broadcast). The number
#: of pivots follows the largest label; it changes only which vectors share a block.
BLOCK = 2_048
MAX_PIVOTS = 256
#: Added to distances in pruning tests, above the rounding errors of unit vectors.
_SLACK = 1e-6


@dataclass
class CoverTree:
    """Nodes in the order of their levels; the root is node 0.

    A node has a center (a row of the points), the distance to its farthest
    point, and the range of its children; a leaf is one point.
    """

    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def to_bytes(self) -> bytes:
        return np.stack([self.center, self.radius, self.start, self.end]).astype(np.float64).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CoverTree":
        center, radius, start, end = np.frombuffer(data, np.float64).reshape(4, -1)
        return cls(center.astype(np.int64), radius, start.astype(np.int64), end.astype(np.int64))

    def below(self, node: int) -> np.ndarray:
        """The children of a node, or a leaf itself."""
        if self.start[node] == self.end[node]:
            return np.array([node])
        return np.arange(self.start[node], self.end[node])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cover_tree(points: np.ndarray) -> CoverTree:
    """The cover tree of unit vectors; the first point is the root's center.

    A child keeps its parent's center or is farther than the level's radius from
    the centers before it; a point goes to the first center that covers it. Only the
    distances of a node's own points to its children's centers are computed.
    """

    def distances(center: int, own: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (points[own] @ points[center]), 0))

    whole = np.arange(len(points))
    first = distances(0, whole)
    centers, radii, starts, ends = [0], [float(first.max())], [0], [0]
    # A node, its points, their distances to its center, and its level's radius.
    open_ = deque([(0, whole, first, 2.0)])
    while open_:
        node, own, far, radius = open_.popleft()
        if len(own) == 1:
            continue
        starts[node] = len(centers)
        while radius / 2 >= radii[node] and radius > _SLACK:
            radius /= 2
        radius /= 2
        if radius <= _SLACK:
            # Points on one spot cannot be told apart by radii: a leaf for each.
            centers += own.tolist()
            radii += [0.0] * len(own)
            starts += [0] * len(own)
            ends += [0] * len(own)
        else:
            left, center = own, centers[node]
            while len(left):
                near = far <= radius
                child = len(centers)
                centers.append(int(center))
                radii.append(float(far[near].max()))
                starts.append(0)
                ends.append(0)
                open_.append((child, left[near], far[near], radius))
                left = left[~near]
                if len(left):
                    center = left[0]
                    far = distances(center, left)
        ends[node] = len(centers)
    return CoverTree(*map(np.array, (centers, radii, starts, ends)))


def close_pairs(a: np.ndarray, tree_a: CoverTree, b: np.ndarray, tree_b: CoverTree, cosine: float):
    """(rows of a, rows of b) with at least the given cosine, by dual traversal."""
    reach = np.sqrt(2 - 2 * cosine) + _SLACK
    leaf_a, leaf_b = tree_a.start == tree_a.end, tree_b.start == tree_b.end
    open_ = [(np.array([0]), np.array([0]))]
    while open_:
        p, q = open_.pop()
        if not len(p) or not len(q):
            continue
        i, j = tree_a.center[p], tree_b.center[q]
        dots = a[i] @ b[j].T
        bound = tree_a.radius[p][:, None] + tree_b.radius[q][None, :] + reach
        x, y = np.nonzero(2 - 2 * dots <= bound * bound)
        leaf = leaf_a[p[x]] & leaf_b[q[y]]
        found = leaf & (dots[x, y] >= cosine)
        if found.any():
            yield i[x[found]], j[y[found]]
        p, q = p[x[~leaf]], q[y[~leaf]]
        # The leaves that meet one node go down together, pairs of nodes by themselves.
        for m in np.unique(p[~leaf_a[p]]).tolist():
            with_m = q[p == m]
            open_.append((tree_a.below(m), with_m[leaf_b[with_m]]))
            open_ += [(tree_a.below(m), tree_b.below(n)) for n in with_m[~leaf_b[with_m]].tolist()]
        for n in np.unique(q[~leaf_b[q]]).tolist():
            with_n = p[q == n]
            open_.append((with_n[leaf_a[with_n]], tree_b.below(n)))


def _spread(key: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), n).cast("int")


def _label_key(vectors: DataFrame, label_col: str) -> Column:
    """A string that is equal for equal labels of whatever type, null for null."""
    kind, label = dict(vectors.dtypes)[label_col], F.col(label_col)
    if kind == "binary":
        return F.hex(label)
    return (label + F.lit(0).cast(kind) if kind in ("float", "double") else label).cast("string")


def _usable(vectors: DataFrame) -> DataFrame:
    """Distinct vectors that can link, with the smallest id and the number of ids."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.where("label is not null and vec is not null and vec_id is not null")
        .where(finite & F.exists("vec", lambda x: x != 0))
        .groupBy("label", "vec")
        .agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"))
    )


def _blocks(classes: DataFrame, block: int) -> DataFrame:
    """One row per block: its vectors, ids, copies and cover tree, a center and a radius."""
    spark = classes.sparkSession
    sizes = classes.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    wanted = int(min(MAX_PIVOTS, -(-largest // block)))
    pivots = classes.orderBy(F.xxhash64("node"), "node").select("vec").limit(max(wanted, 1)).collect()
    shared = spark.sparkContext.broadcast([np.array(p.vec, np.float64) for p in pivots])

    def nearest(vec: pd.Series) -> pd.Series:
        found = np.zeros(len(vec), np.int32)
        rows = [np.asarray(v, np.float64) for v in vec]
        for dim in {len(r) for r in rows}:
            at = [k for k, r in enumerate(rows) if len(r) == dim]
            centers = [p for p in shared.value if len(p) == dim]
            if len(centers) > 1:
                found[at] = np.argmax(np.stack([rows[k] for k in at]) @ unit(np.stack(centers)).T, axis=1)
        return pd.Series(found)

    cell = F.pandas_udf(nearest, "int")(F.col("vec"))
    placed = materialise(classes.withColumn("dim", F.size("vec")).withColumn("cell", cell), "cells")
    key = ["label", "dim", "cell"]
    slices = placed.groupBy(*key).agg(F.ceil(F.count("*") / block).alias("slices"))
    rows = placed.join(slices, key).withColumn("slice", _spread(F.col("node"), F.col("slices")))

    def pack(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("node")
        vectors = np.stack([np.asarray(v, np.float64) for v in found["vec"]])
        points = unit(vectors)
        mean = points.mean(axis=0)
        size = np.linalg.norm(mean)
        center = mean / size if size > 0 else points[0]
        far = np.sqrt(np.maximum(2 - 2 * (points @ center), 0)).max()
        first = found.iloc[0]
        return pd.DataFrame(
            {
                "label": [first["label"]],
                "dim": [first["dim"]],
                "block": [int(first["node"])],
                "center": [center.tolist()],
                "radius": [float(far)],
                "nodes": [found["node"].to_numpy(np.int64).tobytes()],
                "copies": [found["copies"].to_numpy(np.int64).tobytes()],
                "vectors": [vectors.tobytes()],
                "tree": [cover_tree(points).to_bytes()],
            }
        )

    schema = "label string, dim int, block long, center array<double>, radius double, nodes binary, copies binary, vectors binary, tree binary"
    return materialise(rows.groupBy(*key, "slice").applyInPandas(pack, schema), "blocks")


def _block_links(found: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links between the one or two blocks of a pair, counted and spanned per vector."""
    sides = []
    for row in found.sort_values("block").itertuples():
        points = unit(np.frombuffer(row.vectors, np.float64).reshape(-1, row.dim))
        nodes, copies = np.frombuffer(row.nodes, np.int64), np.frombuffer(row.copies, np.int64)
        sides.append((points, nodes, copies, CoverTree.from_bytes(row.tree)))
    (a, ids_a, copies_a, tree_a), (b, ids_b, copies_b, tree_b) = sides[0], sides[-1]
    same = len(sides) == 1
    count_a, count_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in close_pairs(a, tree_a, b, tree_b, cosine):
        if same:
            i, j = i[i != j], j[i != j]
        np.add.at(count_a, i, copies_b[j])
        if not same:
            np.add.at(count_b, j, copies_a[i])
        for x, y in zip(ids_a[i].tolist(), ids_b[j].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    ids = ids_a if same else np.concatenate((ids_a, ids_b))
    counts = count_a if same else np.concatenate((count_a, count_b))
    linked = counts > 0
    return pd.DataFrame(
        {"node": ids[linked], "links": counts[linked], "root": [root(x) for x in ids[linked].tolist()]}
    )


def embedding_components(
    vectors: DataFrame,
    cosine: float = THRESHOLD,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two vectors link when their labels are equal and not null and their cosine is
    at least ``cosine`` in double precision; labels are of any type. Null or zero vectors and those with null or non-finite
    components link with nothing, nor do vectors of different lengths or with a
    null id. Equal vectors are compared once as a class and count with all their
    ids. Rows that share an id are one vertex; without an id there is no component;
    an empty table gives an empty result.
    """
    rows = materialise(
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(vec_col).cast("array<double>").alias("vec"),
            _label_key(vectors, label_col).alias("label"),
        ),
        "vectors",
    )
    classes = materialise(_usable(rows), "classes")
    blocks = _blocks(classes, block)
    ends = blocks.select("label", "dim", "block", "center", "radius")
    gap = F.sqrt(F.aggregate(F.zip_with("center", "center2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    reach = F.col("radius") + F.col("radius2") + F.lit(float(np.sqrt(2 - 2 * cosine)) + _SLACK)
    pairs = (
        ends.join(ends.toDF("label", "dim", "block2", "center2", "radius2"), ["label", "dim"])
        .where((F.col("block") <= F.col("block2")) & (gap <= reach))
        .select(F.col("block").alias("p"), F.col("block2").alias("q"))
    )
    sides = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    content = blocks.select("block", "dim", "nodes", "copies", "vectors", "tree")
    links = materialise(
        sides.join(content, "block")
        .groupBy("p", "q")
        .applyInPandas(lambda found: _block_links(found, cosine), "node long, links long, root long"),
        "links",
    )
    roots = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = (
        classes.join(counts, "node", "left")
        .join(roots, "node", "left")
        .select(
            "label",
            "vec",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("component_id"),
        )
    )
    named = F.col("vec_id").isNotNull()
    own = F.when(named, F.coalesce("component_id", "vec_id"))
    return rows.join(by_class, ["label", "vec"], "left").select(
        "vec_id",
        F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        own.alias("component_id"),
        (F.col("vec_id") == own).alias("kept"),
    )
