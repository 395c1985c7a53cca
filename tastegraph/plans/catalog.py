"""Every operator as a named query over the benchmark tables."""

from collections.abc import Callable
from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegraph import config
from tastegraph.fixtures import VECTOR_DIM, Fixtures
from tastegraph.functions import ids, scores, text
from tastegraph.operators import (
    evaluate,
    features,
    graph,
    joins,
    matrix,
    models,
    neighbours,
    vectors,
    walks,
)
from tastegraph.operators.boosting import SCHEMA, Ensemble
from tastegraph.session import materialise, scratch_path
from tastegraph.sources import readers, schemas, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Walks per node that ignore the direction of edges: such walks never end early, and 250
# of them are some minutes' work on one machine even at small scale (see README). All
# other queries run with the full values.
UNDIRECTED_WALKS = 25
UNDIRECTED_VECTOR_WALKS = 1

tables = lru_cache(maxsize=4)(Fixtures)


def query(fn):
    """Register ``fn(fixtures) -> DataFrame`` under its own name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
    return fn


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def vector_sums(df: DataFrame, name: str) -> DataFrame:
    """Replace a vector by its size, sum and position-weighted sum."""
    plain = F.aggregate(name, F.lit(0.0), lambda acc, x: acc + x)
    weighted = F.aggregate(
        F.transform(name, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return df.withColumns(
        {
            f"{name}_size": F.size(name).cast("bigint"),
            f"{name}_sum": F.round(plain, 5),
            f"{name}_weighted": F.round(weighted, 4),
        }
    ).drop(name)


# ---- sources and sinks ---------------------------------------------------------

@query
def read_ratings(fx):
    path = scratch_path(fx.spark, "ratings")
    writers.write_ratings(fx.ratings, path)
    return readers.read_ratings(fx.spark, path)


@query
def read_pairs(fx):
    path = scratch_path(fx.spark, "pairs")
    writers.write_ratings(fx.pairs, path)
    return readers.read_pairs(fx.spark, path, header="user_id,business_id,stars")


@query
def read_pairs_parts(fx):
    """A folder where a small file has the header and a larger one has not."""
    path = scratch_path(fx.spark, "parts")
    line = F.concat_ws(",", "user_id", "business_id").alias("value")
    lines = fx.pairs.select(line)
    header = lines.limit(1).select(F.lit("user_id,business_id").alias("value"))
    header.write.text(path)
    lines.write.mode("append").text(path)
    return readers.read_pairs(fx.spark, path)


@query
def drop_header_lines(fx):
    path = scratch_path(fx.spark, "lines")
    header = "user_id,business_id,stars"
    line = F.concat_ws(",", "user_id", "business_id", F.col("stars").cast("int"))
    fx.ratings.select(F.explode(F.array(F.lit(header), line)).alias("value")).write.text(path)
    return readers.drop_header_lines(fx.spark.read.text(path), header)


def _json(fx, df, read):
    path = scratch_path(fx.spark, "json")
    df.write.json(path)
    return read(fx.spark, path)


@query
def read_business_json(fx):
    return _json(fx, fx.business, readers.read_business)


@query
def read_photo_json(fx):
    return _json(fx, fx.photo, readers.read_photo)


@query
def read_reviews_json(fx):
    return _json(fx, fx.reviews, readers.read_reviews)


@query
def read_users_json(fx):
    return _json(fx, fx.users, readers.read_users)


@query
def read_vectors_wide(fx):
    path = scratch_path(fx.spark, "vectors")
    writers.write_vectors(fx.vectors, path, VECTOR_DIM)
    return vector_sums(readers.read_vectors(fx.spark, path, VECTOR_DIM), "embedding")


@query
def edge_lines(fx):
    return writers.edge_lines(_edges(fx))


@query
def read_edge_lines(fx):
    path = scratch_path(fx.spark, "edges")
    writers.write_edges(_edges(fx), path)
    return readers.read_edges(fx.spark, path)


@query
def vectors_wide(fx):
    nodes = graph.graph_nodes(_edges(fx))
    wide = writers.widen_vectors(nodes.join(fx.vectors, "id"), VECTOR_DIM)
    return wide.select(
        "id", *[F.round(F.col(f"E_{i}").cast("double"), 6).alias(f"E_{i}") for i in range(VECTOR_DIM)]
    )


@query
def predictions_out(fx):
    path = scratch_path(fx.spark, "predictions")
    writers.write_predictions(_baseline_predictions(fx), path)
    back = fx.spark.read.schema(schemas.PAIRS + ", prediction double")
    return rounded(back.option("header", True).csv(path), "prediction")


# ---- projections, filters, scalar functions -----------------------------------------

@query
def user_interactions(fx):
    return features.user_interactions(fx.users)


@query
def user_compliments(fx):
    return features.user_compliments(fx.users)


@query
def photo_count(fx):
    return features.photo_count(fx.photo)


@query
def businesses_in_scope(fx):
    return graph.in_scope(
        fx.business.select("business_id"), "business_id", fx.ratings, fx.pairs
    )


@query
def users_in_scope(fx):
    return graph.in_scope(fx.users.select("user_id"), "user_id", fx.ratings, fx.pairs)


@query
def category_labels(fx):
    return graph.category_labels(fx.business)


@query
def category_node_ids(fx):
    labels = graph.category_labels(fx.business).select("label").distinct()
    return labels.select("label", ids.label_node(F.col("label")).alias("node"))


@query
def user_num_friends(fx):
    return fx.users.select("user_id", text.num_friends(F.col("friends")).alias("num_friends"))


@query
def user_years_on_site(fx):
    years = text.years_on_site(F.col("yelping_since"), config.AS_OF_YEAR)
    return fx.users.select("user_id", years.alias("years_on_site"))


@query
def typed_ids(fx):
    return fx.pairs.select(
        ids.user_node(F.col("user_id")).alias("uid"),
        ids.business_node(F.col("business_id")).alias("bid"),
    )


@query
def poly_hash_bucket(fx):
    return fx.business.select(
        "business_id",
        ids.poly_hash(F.col("business_id")).alias("id_hash"),
        ids.poly_bucket(F.col("business_id")).alias("id_bucket"),
        ids.poly_hash(F.coalesce("categories", F.lit(""))).alias("categories_hash"),
    )


@query
def poly_hash_partitions(fx):
    """Rows per partition after spreading businesses by their hash bucket."""
    bucket = ids.poly_bucket(F.col("business_id"))
    spread = fx.business.withColumn("bucket", bucket).repartition(config.HASH_BUCKETS, "bucket")
    return spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query
def rows_placed_by_id(fx):
    """Each business with its hash bucket and the partition that it is in."""
    placed = joins.placed_by_id(fx.business, "business_id", config.HASH_BUCKETS)
    return placed.select(
        "business_id",
        ids.poly_bucket(F.col("business_id")).alias("id_bucket"),
        F.spark_partition_id().cast("bigint").alias("partition"),
    )


# ---- aggregates -----------------------------------------------------------------

@query
def item_review_count(fx):
    return features.item_review_count(fx.business)


@query
def item_star_variance(fx):
    return rounded(features.star_variance(fx.reviews, "business_id", "variance"), "variance")


@query
def user_star_variance(fx):
    return rounded(features.star_variance(fx.reviews, "user_id", "variance"), "variance")


@query
def item_review_count_from_reviews(fx):
    return features.review_count(fx.reviews, "business_id", "n_reviews")


@query
def item_mean_stars_from_reviews(fx):
    return rounded(features.mean_stars(fx.reviews, "business_id", "mean_stars"), "mean_stars")


@query
def user_credibility(fx):
    return features.user_credibility(fx.reviews)


@query
def user_review_count_from_reviews(fx):
    return features.review_count(fx.reviews, "user_id", "n_reviews")


@query
def user_mean_stars_from_reviews(fx):
    return rounded(features.mean_stars(fx.reviews, "user_id", "mean_stars"), "mean_stars")


# ---- distinct ids -----------------------------------------------------------------

@query
def distinct_train_ids(fx):
    return features.distinct_ids(fx.ratings)


@query
def distinct_eval_ids(fx):
    return features.distinct_ids(fx.pairs)


@query
def node_ids_in_scope(fx):
    return graph.node_ids_in_scope(fx.ratings, fx.pairs)


# ---- feature tables and enriched pairs -----------------------------------------------

VARIANCES = ["bid_var_stars", "uid_var_stars"]


@query
def item_features(fx):
    keys = fx.pairs.select("business_id").distinct()
    return rounded(
        features.item_features(keys, fx.business, fx.photo, fx.reviews), "bid_var_stars"
    )


@query
def user_features(fx):
    keys = fx.pairs.select("user_id").distinct()
    return rounded(features.user_features(keys, fx.users, fx.reviews), "uid_var_stars")


def _enriched(fx, pairs, variances=False):
    return features.enrich_pairs(
        pairs, fx.business, fx.photo, fx.users, fx.reviews if variances else None
    )


@query
def train_pairs_enriched(fx):
    return rounded(_enriched(fx, fx.ratings, True), *VARIANCES)


@query
def eval_pairs_enriched(fx):
    return rounded(_enriched(fx, fx.pairs.drop("stars"), True), *VARIANCES)


# ---- vectors joined to pairs -----------------------------------------------------------

@query
def category_connections(fx):
    return vectors.category_connections(fx.business)


def _category_means(fx):
    return vectors.category_mean_vector(fx.business, fx.vectors, VECTOR_DIM)


@query
def category_mean_vector(fx):
    return _category_means(fx).select(
        "id", F.posexplode("embedding").alias("pos", "mean")
    ).select("id", F.col("pos").cast("bigint").alias("pos"), F.round("mean", 6).alias("mean"))


@query
def pairs_with_user_vector(fx):
    return vector_sums(vectors.with_user_vector(fx.pairs, fx.vectors, VECTOR_DIM), "user_vec")


@query
def pairs_with_item_vector(fx):
    return vector_sums(
        vectors.with_item_vector(fx.pairs, _category_means(fx), VECTOR_DIM), "item_vec"
    )


@query
def pairs_with_business_vector(fx):
    return vector_sums(vectors.with_item_vector(fx.pairs, fx.vectors, VECTOR_DIM), "item_vec")


@query
def pairs_with_both_vectors(fx):
    both = vectors.with_item_vector(
        vectors.with_user_vector(fx.pairs, fx.vectors, VECTOR_DIM), fx.vectors, VECTOR_DIM,
        counts_from=fx.pairs,
    )
    return vector_sums(vector_sums(both, "user_vec"), "item_vec")


@query
def pairs_with_stored_vectors(fx):
    """Both vectors looked up in a table that lies in buckets by node."""
    stored = vectors.stored_by_node(fx.vectors)
    both = vectors.with_item_vector(
        vectors.with_user_vector(fx.pairs, stored, VECTOR_DIM), stored, VECTOR_DIM,
        counts_from=fx.pairs,
    )
    return vector_sums(vector_sums(both, "user_vec"), "item_vec")


@query
def pairs_with_side_score(fx):
    return vectors.with_side_score(fx.pairs, fx.side_scores)


# ---- graph ------------------------------------------------------------------------

def _edges(fx):
    return graph.build_edges(fx.ratings, fx.pairs, fx.business, fx.users)


@query
def category_edges(fx):
    return graph.category_edges(fx.business, fx.ratings, fx.pairs)


@query
def friend_edges(fx):
    return graph.friend_edges(fx.users, fx.ratings, fx.pairs)


@query
def rating_edges(fx):
    return graph.rating_edges(fx.ratings, fx.pairs)


@query
def edges(fx):
    return _edges(fx)


@query
def graph_nodes(fx):
    return graph.graph_nodes(_edges(fx))


@query
def out_degree(fx):
    return graph.out_degree(_edges(fx))


# ---- walks and learned vectors --------------------------------------------------------

def _walk_step(step):
    def run(fx):
        prepared = walks.prepare(_edges(fx))
        moved = walks.moves(prepared, walk_length=step + 1).where(F.col("step") == step)
        came_from = prepared.nodes.select(F.col("node").alias("prev"), F.col("id").alias("prev_id"))
        return walks.spread(
            moved.join(prepared.nodes, "node")
            .join(came_from, "prev")
            .select("base", "ks", F.col("prev_id").alias("prev"), F.col("id").alias("cur"))
        )

    run.__name__ = f"biased_walk_step{step}"
    return query(run)


for _step in (1, 2, 3, 4):
    _walk_step(_step)


def _paths(fx, directed, num_walks=config.NUM_WALKS):
    prepared = walks.prepare(_edges(fx), directed=directed)
    moved = walks.moves(prepared, num_walks)
    return walks.named_paths(moved, prepared.nodes).select(
        "walk_id",
        F.size("path").cast("bigint").alias("n_nodes"),
        F.array_join("path", " ").alias("path"),
    )


@query
def walk_paths(fx):
    return _paths(fx, True)


@query
def walk_paths_undirected(fx):
    return _paths(fx, False, UNDIRECTED_WALKS)


def _trained_paths(fx, directed=True, num_walks=config.NUM_WALKS):
    prepared = walks.prepare(_edges(fx), directed=directed)
    return walks.walk_paths(walks.visits(prepared, num_walks)), prepared.nodes


def _vector_summary(trained):
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return trained.select(
        "id",
        F.size("embedding").alias("dim"),
        finite.alias("finite"),
        F.exists("embedding", lambda x: x != 0).alias("has_length"),
    )


@query
def node_vectors(fx):
    return _vector_summary(vectors.node_vectors(*_trained_paths(fx)))


def _cosine(left, right):
    def dot(a, b):
        product = F.zip_with(a, b, lambda x, y: (x * y).cast("double"))
        return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)

    size = F.sqrt(dot(left, left) * dot(right, right))
    return F.when(size > 0, dot(left, right) / size)


@query
def linked_nodes_nearer(fx):
    """Whether linked nodes have nearer vectors than nodes that are half the numbers
    apart; numbers follow a hash of the id."""
    linked = materialise(_edges(fx), "edges")
    prepared = walks.prepare(linked)
    paths = walks.walk_paths(walks.visits(prepared))
    trained = materialise(vectors.node_vectors(paths, prepared.nodes), "trained")
    n_nodes = prepared.nodes.count()
    apart = prepared.nodes.withColumn("far", (F.col("node") + n_nodes // 2) % n_nodes)
    others = prepared.nodes.select(F.col("node").alias("far"), F.col("id").alias("dst"))
    pairs = linked.select("src", "dst", F.lit(True).alias("linked")).unionByName(
        apart.join(others, "far").select(F.col("id").alias("src"), "dst", F.lit(False).alias("linked"))
    )
    near = pairs.join(
        trained.select(F.col("id").alias("src"), F.col("embedding").alias("a")), "src"
    ).join(trained.select(F.col("id").alias("dst"), F.col("embedding").alias("b")), "dst")
    cosine = _cosine(F.col("a"), F.col("b"))
    return near.agg(
        F.count_if("linked").alias("n_links"),
        (F.avg(F.when(F.col("linked"), cosine)) > F.avg(F.when(~F.col("linked"), cosine))).alias("nearer"),
    )


@query
def node_vectors_factorised(fx):
    """The method by name, on walks that ignore the direction of edges."""
    paths, nodes = _trained_paths(fx, False, UNDIRECTED_VECTOR_WALKS)
    return _vector_summary(vectors.factorised_vectors(materialise(paths, "paths"), nodes))


@query
def node_vectors_skip_gram(fx):
    paths, nodes = _trained_paths(fx)
    return _vector_summary(vectors.skip_gram_vectors(materialise(paths, "paths"), nodes))


# ---- matrix -----------------------------------------------------------------------

@query
def one_hot_open(fx):
    def items(pairs):
        return features.item_features(
            pairs.select("business_id").distinct(), fx.business, fx.photo
        )

    values = matrix.learn_categories(items(fx.ratings), "is_open")
    hot = matrix.one_hot(items(fx.pairs), "is_open", values)
    return hot.select("business_id", "is_open", *[f"is_open_{v}" for v in values])


@query
def one_hot_city(fx):
    fitted = matrix.fit_one_hot(fx.business, "city")
    flags = vector_to_array(F.col("city_hot"))
    return matrix.one_hot_sparse(fx.business, "city", fitted).select(
        "business_id",
        *(
            flags[k].cast("int").alias("city_" + value.replace("#", "_"))
            for k, value in enumerate(fitted.stages[0].labels)
        ),
    )


def _matrix(fx, pairs):
    values = matrix.learn_categories(fx.business, "is_open")
    enriched = features.enrich_pairs(
        pairs, fx.business, fx.photo, fx.users, user_vectors=fx.vectors,
        item_vectors=_category_means(fx), vector_size=VECTOR_DIM,
    )
    return matrix.feature_matrix(
        enriched, values, vectors=["user_vec", "item_vec"],
        keep=["user_id", "business_id", "stars"],
    )


@query
def feature_matrix(fx):
    return vector_sums(vector_sums(_matrix(fx, fx.pairs), "user_vec"), "item_vec")


@query
def standardised_features(fx):
    train, pairs = _enriched(fx, fx.ratings), _enriched(fx, fx.pairs)
    scaled = matrix.standardise(pairs, train, matrix.SCALARS)
    return rounded(scaled.select("user_id", "business_id", *matrix.SCALARS), *matrix.SCALARS)


@query
def standardised_vectors(fx):
    """The users' vectors of the pairs, scaled as those of the ratings."""
    train = vectors.with_user_vector(fx.ratings, fx.vectors, VECTOR_DIM)
    pairs = vectors.with_user_vector(fx.pairs, fx.vectors, VECTOR_DIM)
    return vector_sums(matrix.standardise(pairs, train, [], ["user_vec"]), "user_vec")


# ---- models ------------------------------------------------------------------------

def _taught(fx, pairs):
    """The model matrix of pairs whose rating follows their features, to be learned."""
    taught = (F.col("bid_avg_stars") + F.col("uid_avg_stars")) / 2
    return matrix.assemble(_matrix(fx, pairs).withColumn("stars", taught))


def _held_out(fx, estimators, blend=None):
    """For each score: rows scored, whether all are finite and in range, and whether
    the error on held-out ratings is below that of their global mean."""
    held = models.fold_of(config.MODEL1_FOLDS, "user_id", "business_id") == 0
    scored = materialise(
        models.held_out_scores(estimators, _taught(fx, fx.ratings), held, blend), "held_out"
    )
    names = [*estimators, *([blend[0]] if blend else [])]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("score"), F.col(n).alias("x")) for n in names)))
    rows = scored.select("stars", each.alias("s")).select("stars", "s.score", "s.x")
    wild = F.isnan("x") | (F.abs("x") == float("inf"))
    return rows.groupBy("score").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(wild) == 0).alias("finite"),
        (F.count_if((F.col("x") < 0.5) | (F.col("x") > 5.5)) == 0).alias("in_range"),
        (F.avg((F.col("x") - F.col("stars")) ** 2) < F.var_pop("stars")).alias("below_mean_error"),
    )


@query
def model1_scores(fx):
    return _held_out(fx, {"model1": models.model1()})


@query
def model2_scores(fx):
    return _held_out(fx, {"model2": models.model2()})


@query
def blended_model_scores(fx):
    """Both models and their blend: the whole scoring path."""
    both = {"score_x": models.model1(), "score_c": models.model2()}
    blend = scores.blend(F.col("score_x"), F.col("score_c"))
    return _held_out(fx, both, ("blend", blend))


@query
def model1_cross_validated(fx):
    """Rows of each fold, and whether the model beats the global mean on it."""
    table = _taught(fx, fx.ratings).withColumn(
        "fold", models.fold_of(config.MODEL1_FOLDS, "user_id", "business_id")
    )
    found = models.cross_validated_rmse(models.model1(), table, config.MODEL1_FOLDS, "fold")
    errors = fx.spark.createDataFrame(list(enumerate(found)), "fold int, rmse double")
    folds = table.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("stars").alias("spread")
    )
    return folds.join(errors, "fold").select(
        "fold", "n", (F.col("rmse") < F.col("spread")).alias("below_mean_error")
    )


GRID = {"depth": [8], "rate": [0.1, 0.12], "column_share": [0.4], "row_share": [0.6]}


@query
def model_grid_search(fx):
    """For each combination and fold: whether the model beats the global mean on it."""
    table = _taught(fx, fx.ratings).withColumn(
        "fold", models.fold_of(config.MODEL1_FOLDS, "user_id", "business_id")
    )
    found = models.grid_search(table, "fold", config.MODEL1_FOLDS, GRID, models.model1(trees=100, leaves=None))
    spread = table.groupBy("fold").agg(F.stddev_pop("stars").alias("spread"))
    return found.join(spread, "fold").select(
        "name", F.col("fold").cast("bigint").alias("fold"), (F.col("rmse") < F.col("spread")).alias("below_mean_error")
    )


# A small model as its table of nodes; the checking SQL repeats it. The
# features are 0 num_photo, 2 bid_avg_stars, 4 uid_num_reviews, 5 uid_avg_stars,
# 22 is_open_0 and 24, the first component of the user's vector.
FIXED_MODEL = [
    (-1, 0, -1, 0.0, -1, -1, 3.0),
    (0, 0, 2, 3.0, 1, 2, 0.0),
    (0, 1, 5, 2.5, 3, 4, 0.0),
    (0, 2, -1, 0.0, -1, -1, 0.5),
    (0, 3, -1, 0.0, -1, -1, -1.0),
    (0, 4, -1, 0.0, -1, -1, -0.25),
    (1, 0, 0, 1.0, 1, 2, 0.0),
    (1, 1, -1, 0.0, -1, -1, -0.125),
    (1, 2, 4, 20.0, 3, 4, 0.0),
    (1, 3, -1, 0.0, -1, -1, 0.0625),
    (1, 4, -1, 0.0, -1, -1, 0.375),
    (2, 0, 22, 0.0, 1, 2, 0.0),
    (2, 1, -1, 0.0, -1, -1, 0.03125),
    (2, 2, 24, 0.0, 3, 4, 0.0),
    (2, 3, -1, 0.0, -1, -1, 0.015625),
    (2, 4, -1, 0.0, -1, -1, -0.015625),
]


@query
def model_round_trip(fx):
    """A model stored as its table of nodes, loaded and applied to the pairs' features."""
    path = scratch_path(fx.spark, "model")
    models.save(Ensemble.from_table(fx.spark.createDataFrame(FIXED_MODEL, SCHEMA)), path)
    return models.predict(models.load(path), matrix.assemble(_matrix(fx, fx.pairs)))


# ---- blending and evaluation --------------------------------------------------------------

def _baseline_scores(fx):
    by_item = evaluate.mean_scores(fx.pairs, fx.ratings, "business_id", "score_x")
    return evaluate.mean_scores(
        by_item, fx.ratings, "user_id", "score_c", counts_from=fx.pairs
    )


def _baseline_predictions(fx):
    return _baseline_scores(fx).withColumn(
        "prediction", scores.blend(F.col("score_x"), F.col("score_c"))
    )


def _blended(fx, column):
    return rounded(
        fx.model_scores.select("user_id", "business_id", "stars", column.alias("prediction")),
        "prediction",
    )


@query
def blend_clamp(fx):
    return _blended(fx, scores.blend(F.col("score_x"), F.col("score_c")))


@query
def blend_clamp_inputs(fx):
    return _blended(fx, scores.blend(F.col("score_x"), F.col("score_c"), clamp_inputs=True))


@query
def blend_three_way(fx):
    return _blended(
        fx, scores.blend_three(F.col("score_x"), F.col("score_c"), F.col("score_n"))
    )


@query
def item_profiles(fx):
    """The slots of each item's profile that hold anything."""
    profiles = neighbours.item_profiles(neighbours.centred_ratings(fx.ratings))
    values = profiles.select("business_id", F.posexplode("profile").alias("slot", "value"))
    return rounded(values, "value").where("value <> 0").select(
        "business_id", F.col("slot").cast("bigint").alias("slot"), "value"
    )


@query
def neighbour_scores(fx):
    return rounded(neighbours.neighbour_scores(fx.pairs, fx.ratings), "score")


@query
def neighbour_scores_of_ratings(fx):
    """The same for rated pairs: each leaves out its own rating."""
    return rounded(neighbours.neighbour_scores(fx.ratings, fx.ratings), "score")


@query
def blend_with_neighbours(fx):
    """The baseline scores blended with the neighbours' where there are any."""
    found = neighbours.neighbour_scores(fx.pairs, fx.ratings)
    scored = vectors.with_side_score(_baseline_scores(fx), found, config.NO_SCORE)
    blended = scores.blend_three(F.col("score_x"), F.col("score_c"), F.col("score"))
    return rounded(
        scored.select("user_id", "business_id", "stars", blended.alias("prediction")), "prediction"
    )


@query
def rmse_eval(fx):
    return rounded(evaluate.holdout_rmse(fx.pairs, _baseline_predictions(fx)), "rmse")


@query
def train_rmse(fx):
    scored = evaluate.mean_scores(fx.ratings, fx.ratings, "business_id", "prediction")
    return rounded(evaluate.rmse(scored), "rmse")


def _cv(fx, folds):
    fold = models.fold_of(folds, "user_id", "business_id")
    return rounded(evaluate.out_of_fold_item_rmse(fx.ratings, folds, fold), "rmse")


@query
def cv_fold_rmse(fx):
    return _cv(fx, config.MODEL1_FOLDS)


@query
def cv_fold_rmse_10(fx):
    return _cv(fx, config.MODEL2_FOLDS)
