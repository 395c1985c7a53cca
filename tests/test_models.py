import pytest
from pyspark.sql import functions as F

from tastegraph import config
from tastegraph.fixtures import VECTOR_DIM
from tastegraph.operators import boosting, evaluate, models
from tastegraph.plans import catalog, pipeline
from tastegraph.session import materialise

# Every tree is shrunk by the rate, the first one too.
SMALL = {"trees": 12, "depth": 3, "rate": 0.3}


@pytest.fixture(scope="module")
def inputs(fx):
    # Ratings here follow the business' own stars, so that there is something to learn.
    signal = fx.business.select("business_id", F.col("stars").alias("own"))
    ratings = (
        fx.ratings.join(signal, "business_id", "left")
        .withColumn("stars", F.coalesce(F.col("own"), F.lit(3.0)) + F.col("stars") / 10)
        .drop("own")
        .select("user_id", "business_id", "stars")
    )
    return pipeline.Inputs(ratings, fx.pairs, fx.business, fx.photo, fx.reviews, fx.users)


@pytest.fixture(scope="module")
def table(spark, inputs, fx):
    folded = inputs.ratings.withColumn("fold", models.fold_of(2, "user_id", "business_id"))
    return materialise(
        pipeline.model_matrix(inputs, folded, fx.vectors, VECTOR_DIM, [0, 1]), "test-matrix"
    )


def test_matrix_width(table):
    assert len(table.first()["features"]) == 22 + 2 + 2 * VECTOR_DIM


def test_models_beat_the_global_mean_on_held_out_rows(table):
    train, rest = table.where("fold = 0"), table.where("fold = 1")
    mean = train.agg(F.avg("stars")).first()[0]
    base = evaluate.rmse(rest.withColumn("prediction", F.lit(mean))).first()["rmse"]
    for estimator in (models.model1(**SMALL), models.model2(**SMALL)):
        scored = models.predict(models.fit(estimator, train), rest)
        assert evaluate.rmse(scored).first()["rmse"] < 0.7 * base


def test_saved_models_give_the_same_scores(spark, inputs, fx, tmp_path):
    trained = pipeline.train(inputs, fx.vectors, VECTOR_DIM, SMALL, SMALL)
    trained.save(str(tmp_path))
    loaded = pipeline.Trained.load(str(tmp_path))
    assert loaded.open_values == trained.open_values == [0, 1]

    first, second = (
        sorted(map(str, pipeline.score(inputs, fx.vectors, t, VECTOR_DIM).collect()))
        for t in (trained, loaded)
    )
    assert first == second and len(first) == inputs.pairs.count()


def test_cross_validation(table):
    found = models.cross_validated_rmse(models.model1(**SMALL), table, 2, "fold")
    assert len(found) == 2 and all(0 < score < 1.5 for score in found)


def test_grid_search_goes_on_after_the_last_result(spark, table, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    values = {"depth": [1, 3], "rate": [0.5]}
    first = models.grid_search(table, "fold", 2, {"depth": [1], "rate": [0.5]}, models.model1(trees=2), path)
    assert first.count() == 2
    trained = []
    real = models._by_fold
    monkeypatch.setattr(models, "_by_fold", lambda *args: trained.append(args[1]) or real(*args))
    found = models.grid_search(table, "fold", 2, values, models.model1(trees=2), path)
    assert [p.depth for p in trained] == [3]
    errors = {(r["name"], r["fold"]): r["rmse"] for r in found.collect()}
    assert set(errors) == {(f"depth={d},rate=0.5", f) for d in (1, 3) for f in (0, 1)}
    assert errors["depth=3,rate=0.5", 0] < errors["depth=1,rate=0.5", 0]
    assert models.best_params(models.model1(trees=2), found, values) == models.model1(trees=2, depth=3, rate=0.5)


def test_fixed_parameters():
    first, second = models.model1(), models.model2()
    assert (first.trees, first.depth, first.rate, first.leaves, first.symmetric) == (400, 7, 0.06, 100, False)
    assert (second.trees, second.depth, second.rate, second.symmetric) == (1200, 7, 0.06, True)


def test_sides_of_the_matrix(table):
    items, users = models._sides(table)
    assert len(items) == 3 + 2 + VECTOR_DIM and len(users) == 19 + VECTOR_DIM
    assert boosting.binned(table).rows == table.count()


def test_jobs_end_to_end(spark, fx, tmp_path):
    """Files in, predictions file out, through all three jobs."""
    folder = str(tmp_path)
    from tastegraph.sources import schemas, writers

    writers.write_ratings(fx.ratings, f"{folder}/ratings.csv")
    writers.write_ratings(fx.pairs.select("user_id", "business_id"), f"{folder}/pairs.csv")
    writers.write_ratings(fx.pairs, f"{folder}/rated_pairs.csv")
    for name in ("business", "photo", "reviews", "users"):
        getattr(fx, name).write.json(f"{folder}/{schemas.FILES[name]}")

    ratings, pairs, models_path = f"{folder}/ratings.csv", f"{folder}/pairs.csv", f"{folder}/m"
    vectors_path = f"{folder}/v.csv"
    small = {"model1": SMALL, "model2": {**SMALL, "depth": 2}}
    pipeline.run_embedding(
        spark, folder, ratings, pairs, vectors_path, num_walks=1, walk_length=4, size=8, window=3
    )
    assert spark.read.option("header", True).csv(vectors_path).columns == ["id"] + [f"E_{i}" for i in range(8)]
    report = pipeline.run_training(
        spark, folder, ratings, f"{folder}/rated_pairs.csv", vectors_path, models_path, size=8,
        folds=(2, 2), with_stars=True, **small,
    )
    parts = ["fold_0", "fold_1", "training", "hold_out"]
    assert set(report) == {f"{part}_{model}" for part in parts for model in small}
    assert all(0 < error < 3 for error in report.values())
    assert spark.read.parquet(f"{models_path}/quality").count() == len(report)

    def scored(name, **settings):
        out = f"{folder}/{name}"
        pipeline.run_scoring(spark, folder, ratings, pairs, vectors_path, models_path, out, size=8, **settings)
        rows = spark.read.option("header", True).csv(out).collect()
        assert len(rows) == fx.pairs.count()
        return {(r["user_id"], r["business_id"]): float(r["prediction"]) for r in rows}

    blended = scored("blended")
    assert all(1.0 <= x <= 5.0 for x in blended.values())
    first, second = scored("first", only="model1"), scored("second", only="model2")
    assert first != second
    weighted = scored("weighted", weights=(1.0, 0.0), clamp_inputs=True)
    assert all(abs(weighted[k] - min(5.0, max(1.0, first[k]))) < 1e-9 for k in first)
    side = fx.side_scores
    three = scored("three", side_scores=side, weights=(0.0, 1e-12, 1.0))
    known = {(r["user_id"], r["business_id"]): r["score"] for r in side.collect()}
    # A pair without a third score is rescaled, never blended with a made-up one.
    assert all(abs(three[k] - known[k]) < 1e-9 for k in known)
    fourth = scored("fourth", side_scores=side, weights=(0.5, 0.0, 0.5))
    missing = [k for k in fourth if k not in known]
    assert missing and all(abs(fourth[k] - first[k]) < 1e-9 for k in missing)
    assert all(abs(fourth[k] - (first[k] + known[k]) / 2) < 1e-9 for k in known)


def test_queries_train_all_trees(monkeypatch, fx, sf_dir):
    asked = []
    monkeypatch.setattr(catalog, "_held_out", lambda fx, models, blend=None: asked.extend(models.values()))
    for name in ("model1_scores", "model2_scores", "blended_model_scores"):
        catalog.QUERIES[name](fx.spark, sf_dir)
    assert [p.trees for p in asked] == [config.MODEL1["trees"], config.MODEL2["trees"]] * 2


def test_blend_with_neighbours_keeps_every_pair(inputs, fx):
    """Pairs without a neighbour keep the two models' scores with rescaled weights."""
    from tastegraph.operators import neighbours

    trained = pipeline.train(inputs, fx.vectors, VECTOR_DIM, SMALL, SMALL)
    # Somebody whom nobody knows has no neighbour.
    asked = inputs.pairs.limit(50).unionByName(
        inputs.pairs.limit(1).withColumn("user_id", F.lit("nobody"))
    )
    pairs = materialise(asked, "asked")
    some = pipeline.Inputs(
        inputs.ratings, pairs, inputs.business, inputs.photo, inputs.reviews, inputs.users
    )
    third = neighbours.neighbour_scores(pairs, inputs.ratings)
    third = {(r["user_id"], r["business_id"]): r["score"] for r in third.collect()}

    def scored(**settings):
        rows = pipeline.score(some, fx.vectors, trained, VECTOR_DIM, **settings).collect()
        return sorted((r["user_id"], r["business_id"], r["prediction"]) for r in rows)

    found = scored(with_neighbours=True)
    first, second = (
        dict((row[:2], row[2]) for row in scored(only=name)) for name in ("model1", "model2")
    )
    assert len(found) == 51 and any(pair[0] == "nobody" for pair in third)
    for user, item, score in found:
        pair = (user, item)
        expected = 0.8 * first[pair] + 0.1 * second[pair]
        expected = expected / 0.9 if third[pair] == -1 else expected + 0.1 * third[pair]
        assert score == pytest.approx(expected, abs=1e-9)
    assert third["nobody", next(item for user, item, _ in found if user == "nobody")] == -1
    assert any(score != -1 for score in third.values())


def test_stored_side_vectors_give_the_same_matrix(inputs, fx):
    side = pipeline.SideVectors.of(inputs, fx.vectors, VECTOR_DIM)
    plain, stored = (
        sorted(
            (r["user_id"], r["business_id"], r["stars"], [round(x, 6) for x in r["features"]])
            for r in pipeline.model_matrix(inputs, inputs.pairs, given, VECTOR_DIM, [0, 1]).collect()
        )
        for given in (side, side.stored())
    )
    assert plain == stored
