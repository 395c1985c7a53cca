"""Connected components of a graph given by its edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import dealt_anew
from tastegraph.session import drop_path, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every linked node.

    Rounds of large-star and small-star steps: a node's larger neighbours, then
    its smaller ones, are attached to the smallest node known nearby, until every
    node hangs on its root. A round is a few sums and joins by node and a written
    table; no node's neighbours are listed anywhere. Self-loops are ignored, so a
    node with no other edge is not in the result; an empty table gives an empty one.
    """
    found, path = materialise(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .where("u != v")
        .distinct(),
        "edges",
        with_path=True,
    )
    state = None
    while state != (now := _summary(found)):
        state = now
        new, new_path = materialise(_small_star(_large_star(found)), "edges", with_path=True)
        drop_path(found.sparkSession, path)
        found, path = new, new_path
    nodes = found.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = found.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return nodes.union(roots).distinct()


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """(larger neighbour, smallest of the neighbourhood) around each node."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.join(dealt_anew(least, "u"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """(smaller neighbour, smallest one) around each node, and the node itself."""
    down = edges.where(F.col("v") <= F.col("u")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(dealt_anew(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.where("u != v").union(own).distinct()
