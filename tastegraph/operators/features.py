"""Item and user feature tables, and pairs enriched with them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph import config
from tastegraph.functions import ids, text
from tastegraph.operators.joins import counted_join


# ---- keys ------------------------------------------------------------------

def key_counts(pairs: DataFrame, column: str) -> DataFrame:
    """Distinct ids of a column with their row count: the key set of a feature
    table, and the measure of which keys are hot, from one shuffle."""
    return pairs.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_ids(pairs: DataFrame) -> DataFrame:
    """Distinct user and business ids, in one frame of (kind, id)."""
    kinds = F.array(
        F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("id")),
        F.struct(F.lit("business").alias("kind"), F.col("business_id").alias("id")),
    )
    return pairs.select(F.inline(kinds)).distinct()


# ---- aggregates, one per source table -----------------------------------------

def photo_count(photo: DataFrame) -> DataFrame:
    """Photos per business, counting only the kept labels."""
    return (
        photo.where(F.col("label").isin(config.PHOTO_LABELS))
        .groupBy("business_id")
        .agg(F.count(F.lit(1)).alias("num_photo"))
    )


def item_review_count(business: DataFrame) -> DataFrame:
    return business.groupBy("business_id").agg(
        F.sum("review_count").cast("bigint").alias("bid_num_review")
    )


def star_variance(reviews: DataFrame, key: str, name: str) -> DataFrame:
    """Population variance of the stars per key; a single review gives 0."""
    return reviews.groupBy(key).agg(F.var_pop("stars").alias(name))


def review_count(reviews: DataFrame, key: str, name: str) -> DataFrame:
    return reviews.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def mean_stars(reviews: DataFrame, key: str, name: str) -> DataFrame:
    return reviews.groupBy(key).agg(F.avg("stars").alias(name))


def user_credibility(reviews: DataFrame) -> DataFrame:
    """Sum of the votes a user's reviews got."""
    votes = F.col("useful") + F.col("funny") + F.col("cool")
    return reviews.groupBy("user_id").agg(F.sum(votes).cast("bigint").alias("credibility"))


# ---- per-row projections ---------------------------------------------------

def user_interactions(users: DataFrame) -> DataFrame:
    return users.selectExpr("user_id", *[f"cast({c} as bigint) as {c}" for c in config.INTERACTIONS])


def user_compliments(users: DataFrame) -> DataFrame:
    names = [f"compliment_{name}" for name in config.COMPLIMENTS]
    return users.selectExpr("user_id", *[f"cast({c} as bigint) as {c}" for c in names])


def business_profile(business: DataFrame) -> DataFrame:
    """Columns taken from the business table, unique by id."""
    return business.selectExpr(
        "business_id",
        "cast(review_count as bigint) as bid_num_review",
        "stars as bid_avg_stars",
        "city",
        "cast(is_open as int) as is_open",
        "true as _known",
    )


def user_profile(users: DataFrame, as_of: int = config.AS_OF_YEAR) -> DataFrame:
    """Columns taken from the user table, unique by id."""
    counts = {
        "uid_num_fans": "fans",
        "uid_num_reviews": "review_count",
        **{f"uid_{c}": c for c in config.INTERACTIONS},
        **{f"uid_compliment_{c}": f"compliment_{c}" for c in config.COMPLIMENTS},
    }
    derived = users.withColumns(
        {
            "uid_num_friends": text.num_friends(F.col("friends")),
            "uid_years_on_site": text.years_on_site(F.col("yelping_since"), as_of),
        }
    )
    return derived.selectExpr(
        "user_id",
        "average_stars as uid_avg_stars",
        "uid_num_friends",
        "uid_years_on_site",
        *[f"cast({source} as bigint) as {name}" for name, source in counts.items()],
        "true as _known",
    )


# ---- feature tables -----------------------------------------------------------

# Values read together as one group from the source: their default applies when
# the id is unknown, not when a single value of a known id is null.
_GROUPED = {"city", "is_open"} | {
    name for name in config.USER_DEFAULTS
    if name.startswith("uid_compliment_") or name in {f"uid_{c}" for c in config.INTERACTIONS}
}


def _with_default(name: str, default) -> str:
    """SQL for a column after a left join, with its default."""
    if isinstance(default, float):
        default = f"{default}d"
    elif isinstance(default, str):
        default = f"'{default}'"
    elif name != "is_open":
        default = f"{default}L"
    if name in _GROUPED:
        return f"case when _known then {name} else {default} end as {name}"
    return f"coalesce({name}, {default}) as {name}"


def item_features(
    keys: DataFrame,
    business: DataFrame,
    photo: DataFrame,
    reviews: DataFrame | None = None,
) -> DataFrame:
    """Features of the businesses in ``keys``, with defaults for unknown ones.

    Without ``reviews`` the star variance is left out: no model uses it, and
    skipping it saves the scan of the review table.
    """
    joined = keys.join(photo_count(photo), "business_id", "left").join(
        business_profile(business), "business_id", "left"
    )
    names = dict(config.ITEM_DEFAULTS)
    if reviews is None:
        names.pop("bid_var_stars")
    else:
        joined = joined.join(
            star_variance(reviews, "business_id", "bid_var_stars"), "business_id", "left"
        )
    return joined.selectExpr(*keys.columns, *[_with_default(k, v) for k, v in names.items()])


def user_features(
    keys: DataFrame,
    users: DataFrame,
    reviews: DataFrame | None = None,
    as_of: int = config.AS_OF_YEAR,
) -> DataFrame:
    """Features of the users in ``keys``, with defaults for unknown ones."""
    joined = keys.join(user_profile(users, as_of), "user_id", "left")
    names = dict(config.USER_DEFAULTS)
    if reviews is None:
        names.pop("uid_var_stars")
    else:
        joined = joined.join(
            star_variance(reviews, "user_id", "uid_var_stars"), "user_id", "left"
        )
    return joined.selectExpr(*keys.columns, *[_with_default(k, v) for k, v in names.items()])


def attach_vector(
    df: DataFrame, vectors: DataFrame, node: Column, name: str, size: int
) -> DataFrame:
    """Rows with the vector of ``node`` in column ``name``; zeros when it has none.

    For tables with one row per node.
    """
    keyed = vectors.select(F.col("id").alias("_node"), F.col("embedding").alias(name))
    return (
        df.withColumn("_node", node)
        .join(keyed, "_node", "left")
        .withColumn(name, F.coalesce(name, zeros_like(vectors, size)))
        .drop("_node")
    )


def zeros_like(vectors: DataFrame, size: int) -> Column:
    """A zero vector of the table's own element type."""
    return F.lit([0.0] * size).cast(vectors.schema["embedding"].dataType)


def enrich_pairs(
    pairs: DataFrame,
    business: DataFrame,
    photo: DataFrame,
    users: DataFrame,
    reviews: DataFrame | None = None,
    as_of: int = config.AS_OF_YEAR,
    hot_rows: int = config.HOT_ROWS,
    user_vectors: DataFrame | None = None,
    item_vectors: DataFrame | None = None,
    vector_size: int = config.VECTOR_SIZE,
) -> DataFrame:
    """Pairs with the features of their item and of their user.

    Every pair stays, repeated pairs included, with all its own columns. Vector
    tables, keyed by node id, are attached to the users and items first, so the
    pairs themselves are shuffled once per side whatever is joined.
    """
    item_keys = key_counts(pairs, "business_id")
    user_keys = key_counts(pairs, "user_id")
    items = item_features(item_keys, business, photo, reviews)
    people = user_features(user_keys, users, reviews, as_of)
    if item_vectors is not None:
        items = attach_vector(
            items, item_vectors, ids.business_node(F.col("business_id")), "item_vec", vector_size
        )
    if user_vectors is not None:
        people = attach_vector(
            people, user_vectors, ids.user_node(F.col("user_id")), "user_vec", vector_size
        )
    with_items = counted_join(pairs, items, ["business_id"], item_keys, hot_rows)
    return counted_join(with_items, people, ["user_id"], user_keys, hot_rows)
