"""The three jobs end to end: node vectors, training, scoring."""

import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegraph import config
from tastegraph.functions import scores
from tastegraph.operators import (
    evaluate,
    features,
    graph,
    matrix,
    models,
    neighbours,
    vectors,
    walks,
)
from tastegraph.operators.boosting import Ensemble, Params
from tastegraph.operators.joins import assert_unique
from tastegraph.session import materialise, temporary_scratch
from tastegraph.sources import readers, schemas, writers


@dataclass
class Inputs:
    """The tables of one run."""

    ratings: DataFrame
    pairs: DataFrame
    business: DataFrame
    photo: DataFrame
    reviews: DataFrame
    users: DataFrame

    @classmethod
    def read(
        cls, spark: SparkSession, folder: str, ratings_path: str, pairs_path: str,
        with_stars: bool = False,
    ):
        """The usual files of a data folder, the known ratings and the pairs to score."""
        def path(table):
            return os.path.join(folder, schemas.FILES[table])

        return cls(
            ratings=readers.read_ratings(spark, ratings_path),
            pairs=readers.read_pairs(spark, pairs_path, with_stars=with_stars),
            business=readers.read_business(spark, path("business")),
            photo=readers.read_photo(spark, path("photo")),
            reviews=readers.read_reviews(spark, path("reviews")),
            users=readers.read_users(spark, path("users")),
        )

    def stored(self) -> "Inputs":
        """The same with the tables that are read several times stored in columns.

        Text and JSON cannot be read column by column, and each scan would
        parse every line again.
        """
        return replace(
            self,
            ratings=materialise(self.ratings, "ratings"),
            pairs=materialise(self.pairs, "pairs"),
            business=materialise(self.business, "business"),
            users=materialise(self.users, "users"),
        )

    def check(self) -> None:
        """Profile tables must have one row per id, or joins would add pairs."""
        assert_unique(self.business, ["business_id"], "business")
        assert_unique(self.users, ["user_id"], "users")


# ---- job 1: node vectors ---------------------------------------------------------

def embed(
    inputs: Inputs,
    directed: bool = True,
    num_walks: int = config.NUM_WALKS,
    walk_length: int = config.WALK_LENGTH,
    p: float = config.RETURN_P,
    q: float = config.IN_OUT_Q,
    size: int = config.VECTOR_SIZE,
    window: int = config.WINDOW,
    seed: int = 0,
) -> DataFrame:
    """Vector of every user, business and label node of the graph."""
    edges = graph.build_edges(inputs.ratings, inputs.pairs, inputs.business, inputs.users)
    prepared = walks.prepare(edges, directed)
    visited = walks.visits(prepared, num_walks, walk_length, p, q, seed)
    return vectors.node_vectors(
        walks.walk_paths(visited), prepared.nodes, size, window, seed
    )


def run_embedding(
    spark: SparkSession, folder: str, ratings_path: str, pairs_path: str, vectors_path: str,
    size: int = config.VECTOR_SIZE, **settings,
) -> None:
    """Read the inputs, learn the vectors and store them, see ``writers.store_vectors``."""
    with temporary_scratch(spark):
        inputs = Inputs.read(spark, folder, ratings_path, pairs_path).stored()
        inputs.check()
        writers.store_vectors(embed(inputs, size=size, **settings), vectors_path, size)


# ---- job 2: training -------------------------------------------------------------

@dataclass
class Trained:
    """Both models and the one-hot values they were trained with."""

    first: Ensemble
    second: Ensemble
    open_values: list

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        models.save(self.first, os.path.join(path, "model1"))
        models.save(self.second, os.path.join(path, "model2"))
        spark.createDataFrame([(v,) for v in self.open_values], "is_open int").coalesce(1).write.mode(
            "overwrite"
        ).parquet(os.path.join(path, "open_values"))

    @classmethod
    def load(cls, path: str) -> "Trained":
        rows = SparkSession.active().read.parquet(os.path.join(path, "open_values")).collect()
        return cls(
            models.load(os.path.join(path, "model1")),
            models.load(os.path.join(path, "model2")),
            sorted(row["is_open"] for row in rows),
        )


@dataclass
class SideVectors:
    """The vectors of users, and those of items: the means over an item's labels."""

    users: DataFrame
    items: DataFrame

    @classmethod
    def of(cls, inputs: Inputs, node_vectors: DataFrame, size: int) -> "SideVectors":
        return cls(node_vectors, vectors.category_mean_vector(inputs.business, node_vectors, size))

    def stored(self) -> "SideVectors":
        """Both in buckets by node, for a job that builds several matrices: the means are
        formed once, and no matrix shuffles a vector to look it up."""
        return SideVectors(vectors.stored_by_node(self.users), vectors.stored_by_node(self.items))


def model_matrix(
    inputs: Inputs, pairs: DataFrame, node_vectors: DataFrame | SideVectors, size: int,
    open_values: list,
) -> DataFrame:
    """Pairs as ``features`` in model order, with their own columns kept."""
    if isinstance(node_vectors, DataFrame):
        node_vectors = SideVectors.of(inputs, node_vectors, size)
    enriched = features.enrich_pairs(
        pairs, inputs.business, inputs.photo, inputs.users,
        user_vectors=node_vectors.users, item_vectors=node_vectors.items, vector_size=size,
    )
    names = ["user_vec", "item_vec"]
    return matrix.assemble(
        matrix.feature_matrix(enriched, open_values, vectors=names, keep=pairs.columns), names
    )


def learned_open_values(inputs: Inputs) -> list:
    """The one-hot values of the training data."""
    seen = features.item_features(
        inputs.ratings.select("business_id").distinct(), inputs.business, inputs.photo
    )
    return matrix.learn_categories(seen, "is_open")


def train(
    inputs: Inputs, node_vectors: DataFrame | SideVectors, size: int = config.VECTOR_SIZE,
    model1: dict | None = None, model2: dict | None = None,
) -> Trained:
    """Fit both models on the known ratings."""
    open_values = learned_open_values(inputs)
    table = model_matrix(inputs, inputs.ratings, node_vectors, size, open_values)
    first, second = models.fit_both(
        models.model1(**(model1 or {})), models.model2(**(model2 or {})), table
    )
    return Trained(first, second, open_values)


def cross_validate(
    inputs: Inputs, node_vectors: DataFrame | SideVectors, params: Params, folds: int,
    size: int = config.VECTOR_SIZE, open_values: list | None = None,
) -> list[float]:
    """Held-out RMSE per fold on the known ratings."""
    folded = inputs.ratings.withColumn("fold", models.fold_of(folds, "user_id", "business_id"))
    if open_values is None:
        open_values = learned_open_values(inputs)
    table = model_matrix(inputs, folded, node_vectors, size, open_values)
    return models.cross_validated_rmse(params, table, folds, "fold")


def quality(
    inputs: Inputs, node_vectors: DataFrame | SideVectors, trained: Trained,
    size: int = config.VECTOR_SIZE,
) -> dict[str, float]:
    """RMSE of each model on the ratings it was fitted to and, where the pairs carry
    ratings, on the pairs."""
    found = {}
    tables = {"training": inputs.ratings}
    if "stars" in inputs.pairs.columns:
        tables["hold_out"] = inputs.pairs
    for part, pairs in tables.items():
        table = model_matrix(inputs, pairs, node_vectors, size, trained.open_values)
        both = materialise(models.predict_both(trained.first, trained.second, table), "scored")
        for name, column in (("model1", "score_x"), ("model2", "score_c")):
            found[f"{part}_{name}"] = evaluate.rmse(both, prediction=column).first()["rmse"]
    return found


def run_training(
    spark: SparkSession, folder: str, ratings_path: str, pairs_path: str, vectors_path: str,
    models_path: str, size: int = config.VECTOR_SIZE, folds: tuple[int, int] | None = None,
    with_stars: bool = False, model1: dict | None = None, model2: dict | None = None,
) -> dict:
    """Fit and store both models; returns their errors, which are also stored.

    ``folds`` cross-validates the first and the second model before. With
    ``with_stars`` the pairs file has ratings and is scored as the hold-out.
    """
    with temporary_scratch(spark):
        inputs = Inputs.read(spark, folder, ratings_path, pairs_path, with_stars).stored()
        inputs.check()
        loaded = readers.load_vectors(spark, vectors_path, size)
        node_vectors = SideVectors.of(inputs, loaded, size).stored()
        report = {}
        if folds:
            each = (models.model1(**(model1 or {})), models.model2(**(model2 or {})))
            for name, params, n in zip(("model1", "model2"), each, folds, strict=True):
                found = cross_validate(inputs, node_vectors, params, n, size)
                report |= {f"fold_{k}_{name}": error for k, error in enumerate(found)}
        trained = train(inputs, node_vectors, size, model1, model2)
        trained.save(models_path)
        report |= quality(inputs, node_vectors, trained, size)
        spark.createDataFrame(list(report.items()), "measure string, rmse double").coalesce(
            1
        ).write.mode("overwrite").parquet(os.path.join(models_path, "quality"))
        return report


# ---- job 3: scoring --------------------------------------------------------------

def score(
    inputs: Inputs, node_vectors: DataFrame, trained: Trained, size: int = config.VECTOR_SIZE,
    clamp_inputs: bool = False, weights: tuple | None = None, side_scores: DataFrame | None = None,
    only: str | None = None, with_neighbours: bool = False,
) -> DataFrame:
    """Predictions for the pairs, one per input row.

    Both models are blended, with a third score per pair if ``side_scores`` has
    one, and with rescaled weights where it has none; ``weights`` replace the usual ones.
    ``with_neighbours`` takes the third score from the ratings, see
    :func:`neighbours.neighbour_scores`. ``only`` names a single model, ``model1`` or
    ``model2``, whose scores are returned as they are.
    """
    table = model_matrix(inputs, inputs.pairs, node_vectors, size, trained.open_values)
    columns = inputs.pairs.columns
    if only:
        model = {"model1": trained.first, "model2": trained.second}[only]
        return models.predict(model, table).select(*columns, "prediction")
    both = models.predict_both(trained.first, trained.second, table)
    first, second = F.col("score_x"), F.col("score_c")
    if with_neighbours:
        side_scores = neighbours.neighbour_scores(inputs.pairs, inputs.ratings)
    if side_scores is None:
        blended = scores.blend(first, second, weights or config.BLEND_WEIGHTS, clamp_inputs)
    else:
        both = vectors.with_side_score(both, side_scores, config.NO_SCORE)
        blended = scores.blend_three(first, second, F.col("score"), weights or config.THREE_WAY_WEIGHTS)
    return both.select(*columns, blended.alias("prediction"))


def run_scoring(
    spark: SparkSession, folder: str, ratings_path: str, pairs_path: str, vectors_path: str,
    models_path: str, out_path: str, size: int = config.VECTOR_SIZE, **settings,
) -> None:
    """Read the inputs and the models, write the predictions; settings as in :func:`score`."""
    with temporary_scratch(spark):
        inputs = Inputs.read(spark, folder, ratings_path, pairs_path).stored()
        inputs.check()
        node_vectors = readers.load_vectors(spark, vectors_path, size)
        trained = Trained.load(models_path)
        writers.write_predictions(score(inputs, node_vectors, trained, size, **settings), out_path)
