"""Edges between users, businesses and category labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph import config
from tastegraph.functions import ids, text
from tastegraph.operators.joins import skew_join
from tastegraph.session import materialise


def node_ids_in_scope(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct typed ids over known ratings and pairs to score: (kind, id)."""
    kinds = F.array(
        F.struct(F.lit("user").alias("kind"), ids.user_node(F.col("user_id")).alias("id")),
        F.struct(
            F.lit("business").alias("kind"), ids.business_node(F.col("business_id")).alias("id")
        ),
    )
    return known_pairs(ratings, pairs).select(F.inline(kinds)).distinct()


def in_scope(df: DataFrame, key: str, ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose id occurs in the ratings or in the pairs to score."""
    known = ratings.select(key).union(pairs.select(key)).distinct()
    return df.join(known, key, "left_semi")


def category_labels(business: DataFrame, keep_empty: bool = True) -> DataFrame:
    """One row per business and cleaned label, repeats kept."""
    return business.select(
        "business_id",
        F.explode(text.clean_labels(F.col("categories"), keep_empty)).alias("label"),
    )


def ordered_pair(first, second):
    """Two ids as (src, dst) in lexicographic order."""
    return F.least(first, second).alias("src"), F.greatest(first, second).alias("dst")


def known_pairs(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (user, item) pairs of both tables, from which all ids in scope come."""
    names = ["user_id", "business_id"]
    return ratings.select(*names).unionByName(pairs.select(*names))


def _category_pairs(business, known):
    scope = known.select("business_id").distinct()
    scoped = business.select("business_id", "categories").join(scope, "business_id", "left_semi")
    labels = category_labels(scoped, keep_empty=False)
    return labels.select(
        *ordered_pair(ids.business_node(F.col("business_id")), ids.label_node(F.col("label")))
    )


def _friend_pairs(users, known, hot_rows):
    known = known.select("user_id").distinct()
    asked = users.select("user_id", "friends").join(known, "user_id", "left_semi")
    listed = asked.select("user_id", F.explode(text.friend_ids(F.col("friends"))).alias("friend"))
    kept = skew_join(
        listed, known.withColumnRenamed("user_id", "friend"), ["friend"], "left_semi", hot_rows
    )
    return kept.select(
        *ordered_pair(ids.user_node(F.col("user_id")), ids.user_node(F.col("friend")))
    )


def _rating_pairs(known):
    return known.select(
        ids.user_node(F.col("user_id")).alias("src"),
        ids.business_node(F.col("business_id")).alias("dst"),
    )


def category_edges(business: DataFrame, ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct edges between businesses in scope and their label nodes."""
    return _category_pairs(business, known_pairs(ratings, pairs)).distinct()


def friend_edges(
    users: DataFrame, ratings: DataFrame, pairs: DataFrame, hot_rows: int = config.HOT_ROWS
) -> DataFrame:
    """Distinct edges between friends who are both in scope."""
    return _friend_pairs(users, known_pairs(ratings, pairs), hot_rows).distinct()


def rating_edges(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct edges from users to the businesses they rated or are to be scored on."""
    return _rating_pairs(known_pairs(ratings, pairs)).distinct()


def build_edges(
    ratings: DataFrame,
    pairs: DataFrame,
    business: DataFrame,
    users: DataFrame,
    hot_rows: int = config.HOT_ROWS,
) -> DataFrame:
    """All edges of the graph, each once; one shuffle removes the repeats.

    The pairs are stored first: every family of edges asks for their ids, and
    the tables behind them are read once.
    """
    known = materialise(known_pairs(ratings, pairs).distinct(), "known_pairs")
    return (
        _rating_pairs(known)
        .unionByName(_category_pairs(business, known))
        .unionByName(_friend_pairs(users, known, hot_rows))
        .distinct()
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
