"""Node vectors, and joining them to pairs."""

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph import config
from tastegraph.functions import ids, text
from tastegraph.operators import least_squares, skip_gram
from tastegraph.operators.features import attach_vector, key_counts
from tastegraph.operators.joins import counted_join, skew_join
from tastegraph.session import bucketed, materialise


def zeros(size: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), size)


# ---- training ------------------------------------------------------------------

def skip_gram_vectors(
    paths: DataFrame,
    nodes: DataFrame,
    size: int = config.VECTOR_SIZE,
    window: int = config.WINDOW,
    iterations: int = 5,
    seed: int = 0,
    negatives: int = 5,
    blocks: int | None = None,
) -> DataFrame:
    """Skip-gram with negative sampling over walks of node numbers, as ``id, embedding``.

    Nodes are dealt over blocks. A task holds one block of center vectors and one of
    context vectors and learns the co-occurrences between the two, with negatives from
    the same context block; then the context blocks move on by one. After as many turns
    as there are blocks every pair has been learned once. The weights pass from task
    to task as written tables, none through the driver; a lost executor costs the turn
    it was in. ``blocks`` is part of the result and follows the nodes and pairs unless
    given; the same input and seed give the same vectors. Nodes without a neighbour on
    any walk get zeros.
    """
    counts = materialise(cooccurrences(paths, window), "cooccurrences")
    n_nodes, n_pairs = nodes.count(), counts.count()
    if not n_pairs:
        return nodes.select("id", zeros(size).alias("embedding"))
    if blocks is None:
        by_pairs = math.ceil(math.sqrt(n_pairs / config.PAIRS_PER_CELL))
        blocks = max(1, -(-n_nodes // config.NODES_PER_BLOCK), by_pairs)
    cells = materialise(skip_gram.packed_pairs(counts, blocks), "cells")
    state = skip_gram.first_weights(counts, nodes, blocks, size, seed)
    for epoch in range(iterations):
        for turn in range(blocks):
            step = epoch * blocks + turn
            state = skip_gram.learned(state, cells, blocks, turn, negatives, (seed, step), size)
    trained = skip_gram.center_vectors(state, size, blocks)
    return nodes.join(trained, "node", "left").select(
        "id", F.coalesce("embedding", zeros(size)).alias("embedding")
    )


def cooccurrences(paths: DataFrame, window: int = config.WINDOW) -> DataFrame:
    """How often two node numbers lie within ``window`` steps of a walk.

    A walk has a bounded length, so it yields a bounded number of pairs; they
    are summed before the shuffle. Columns: ``center, context, n``.
    """
    spots = paths.select(
        "path", F.posexplode("path").alias("at", "center")
    ).select(
        "center",
        F.explode(
            F.concat(
                F.slice("path", F.greatest(F.col("at") - window + 1, F.lit(1)),
                        F.least(F.col("at"), F.lit(window))),
                F.slice("path", F.col("at") + 2, F.lit(window)),
            )
        ).alias("context"),
    )
    return spots.groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


def factorised_vectors(
    paths: DataFrame,
    nodes: DataFrame,
    size: int = config.VECTOR_SIZE,
    window: int = config.WINDOW,
    iterations: int = 5,
    seed: int = 0,
) -> DataFrame:
    """Vectors from a factorisation of the walks' co-occurrences.

    Alternating least squares for implicit feedback (Hu, Koren and Volinsky,
    2008): whether two nodes share a window is to be explained by the product of
    their vectors, and a pair weighs the more the oftener it does so than by
    chance, by log(1 + observed / expected). Every pair that occurs has a weight
    above zero, so every node that shares a window with another gets a vector
    with a length; other nodes get zeros.

    Counting and solving both run on the executors, in blocks of nodes, so no table
    passes through the driver (see :mod:`tastegraph.operators.least_squares`).
    """
    counts = materialise(cooccurrences(paths, window), "cooccurrences")
    total, pairs = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total:
        return nodes.select("id", zeros(size).alias("embedding"))
    # The window is symmetric, so one set of row sums serves both sides.
    sums = materialise(counts.groupBy("center").agg(F.sum("n").alias("sum")), "sums")
    of_context = sums.select(F.col("center").alias("context"), F.col("sum").alias("context_sum"))
    with_sums = skew_join(counts, sums, ["center"], "inner")
    with_sums = skew_join(with_sums, of_context, ["context"], "inner")
    over_chance = F.col("n") * F.lit(float(total)) / F.col("sum") / F.col("context_sum")
    cells = with_sums.select("center", "context", F.log1p(over_chance).alias("weight"))
    # A block of centers is sent each of its contexts' vectors once: few blocks send little,
    # but one must not name more vectors than a task should hold.
    n_nodes = sums.count()
    blocks = max(
        2 * nodes.sparkSession.sparkContext.defaultParallelism,
        -(-pairs // config.PAIRS_PER_CELL), -(-n_nodes // config.NODES_PER_BLOCK),
        -(-pairs // config.VECTORS_PER_TASK) if n_nodes > config.VECTORS_PER_TASK else 1,
    )
    trained = least_squares.factors(materialise(cells, "weights"), blocks, size, iterations, seed)
    return nodes.join(trained, "node", "left").select(
        "id", F.coalesce("features", zeros(size)).alias("embedding")
    )


METHODS = {"factorise": factorised_vectors, "skip_gram": skip_gram_vectors}


def node_vectors(
    paths: DataFrame,
    nodes: DataFrame,
    size: int = config.VECTOR_SIZE,
    window: int = config.WINDOW,
    seed: int = 0,
    method: str = "factorise",
    **settings,
) -> DataFrame:
    """A vector for every node, from its walks, by the named method at every size."""
    paths = materialise(paths, "paths")
    return METHODS[method](paths, nodes, size, window, seed=seed, **settings)


def stored_by_node(vectors: DataFrame) -> DataFrame:
    """The table in buckets of its ids, for one that is joined several times.

    A lookup by node then shuffles the ids that ask, and no vector. There are at least
    as many buckets as a shuffle has partitions: else Spark would shuffle the buckets.
    """
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-vectors.count() // config.VECTORS_PER_BUCKET))
    return bucketed(vectors.select("id", "embedding"), "vectors", ["id"], buckets)


# ---- side information ------------------------------------------------------------

def category_connections(business: DataFrame) -> DataFrame:
    """``business, node`` rows that take part in a business' category vector.

    One row per label, repeats and empty labels kept, and one for the business
    itself when it has any label. All come from the business' own row, so
    nothing is shuffled; the table must have one row per business.
    """
    own = ids.business_node(F.col("business_id"))
    labels = F.transform(text.clean_labels(F.col("categories")), ids.label_node)
    return business.select(
        own.alias("business"), F.explode(F.concat(labels, F.array(own))).alias("node")
    )


def _connected_vectors(business: DataFrame, vectors: DataFrame, size: int, hot_rows: int):
    connections = category_connections(business)
    joined = skew_join(
        connections, vectors.withColumnRenamed("id", "node"), ["node"], "left", hot_rows
    )
    return joined.select("business", F.coalesce("embedding", zeros(size)).alias("embedding"))


def category_mean_vector(
    business: DataFrame, vectors: DataFrame, size: int, hot_rows: int = config.HOT_ROWS
) -> DataFrame:
    """Mean vector of a business and its labels: ``id, embedding``.

    A label without a vector counts as a zero vector. Sums are combined before
    the shuffle, so a business with very many labels sends one row per task.
    """
    joined = _connected_vectors(business, vectors, size, hot_rows)
    return (
        joined.withColumn("v", array_to_vector("embedding"))
        .groupBy(F.col("business").alias("id"))
        .agg(Summarizer.mean(F.col("v")).alias("mean"))
        .select("id", vector_to_array("mean").alias("embedding"))
    )


# ---- joins to pairs -----------------------------------------------------------

def with_vector(
    pairs: DataFrame,
    vectors: DataFrame,
    key: str,
    node: Column,
    name: str,
    size: int,
    hot_rows: int = config.HOT_ROWS,
    counts_from: DataFrame | None = None,
) -> DataFrame:
    """Pairs with the vector of their ``node`` in column ``name``, zeros without one.

    The vectors are first looked up for the distinct keys. ``counts_from`` names
    the table the keys come from when ``pairs`` is itself a join.
    """
    keys = key_counts(pairs if counts_from is None else counts_from, key)
    return counted_join(
        pairs, attach_vector(keys, vectors, node, name, size), [key], keys, hot_rows
    )


def with_user_vector(
    pairs, vectors, size, hot_rows=config.HOT_ROWS, counts_from=None
) -> DataFrame:
    node = ids.user_node(F.col("user_id"))
    return with_vector(
        pairs, vectors, "user_id", node, "user_vec", size, hot_rows, counts_from
    )


def with_item_vector(
    pairs, vectors, size, hot_rows=config.HOT_ROWS, counts_from=None
) -> DataFrame:
    """Joins either plain business vectors or category means; both are keyed by node id."""
    node = ids.business_node(F.col("business_id"))
    return with_vector(
        pairs, vectors, "business_id", node, "item_vec", size, hot_rows, counts_from
    )


def with_side_score(
    pairs: DataFrame,
    side_scores: DataFrame,
    default: float = config.SIDE_SCORE_DEFAULT,
) -> DataFrame:
    """Pairs with an outside score per (user, item); ``default`` when there is none.

    Few rows share both ids, so hot keys are not counted: that would be a second
    shuffle of all pairs. Adaptive execution splits one that is repeated often.
    """
    joined = pairs.join(side_scores, ["user_id", "business_id"], "left")
    return joined.withColumn("score", F.coalesce("score", F.lit(default)))
