import pytest
from pyspark.sql import functions as F

from tastegraph.operators import evaluate, features, graph, matrix, vectors
from tastegraph.sources import schemas


@pytest.fixture(scope="module")
def tiny(spark):
    business = spark.createDataFrame(
        [("b1", 7, 4.5, "X", 0, "A, A, B"), ("b2", None, None, None, None, None)],
        schemas.BUSINESS,
    )
    photo = spark.createDataFrame(
        [("b1", "1", "food"), ("b1", "2", "menu"), ("b1", "3", "drink")], schemas.PHOTO
    )
    reviews = spark.createDataFrame(
        [("u1", 3.0, 0, 0, 0, "b1"), ("u2", 1.0, 1, 2, 3, "b3"), ("u2", 5.0, 0, 0, 1, "b3")],
        schemas.REVIEWS,
    )
    return business, photo, reviews


def test_item_defaults(spark, tiny):
    business, photo, reviews = tiny
    keys = spark.createDataFrame([("b1",), ("b2",), ("b3",), ("b4",)], "business_id string")
    found = {
        r["business_id"]: tuple(r)[1:]
        for r in features.item_features(keys, business, photo, reviews).collect()
    }
    assert found["b1"] == (2, 7, 4.5, 0.0, "X", 0)
    # A known business with null values: scalars take defaults, the group stays null.
    assert found["b2"] == (0, 0, 3.0, 0.0, None, None)
    assert found["b3"] == (0, 0, 3.0, 4.0, "NULL", 1)
    assert found["b4"] == (0, 0, 3.0, 0.0, "NULL", 1)


def test_user_defaults(spark):
    users = spark.createDataFrame([], schemas.USERS)
    keys = spark.createDataFrame([("u",)], "user_id string")
    reviews = spark.createDataFrame([], schemas.REVIEWS)
    row = features.user_features(keys, users, reviews).first().asDict()
    assert row.pop("user_id") == "u"
    assert row.pop("uid_avg_stars") == 3.0 and row.pop("uid_num_friends") == 1
    assert row.pop("uid_years_on_site") == 4
    assert set(row.values()) == {0}


def test_category_mean(spark, tiny):
    business, _, _ = tiny
    label = spark.range(1).select(F.md5(F.lit("a").cast("binary"))).first()[0]
    table = spark.createDataFrame(
        [(label, [1.0, 1.0]), ("b1_bid", [3.0, 3.0])], "id string, embedding array<float>"
    )
    # Labels a, a, b and the business itself; b has no vector and counts as zero.
    for hot_rows in (10, 1):
        found = vectors.category_mean_vector(business, table, 2, hot_rows).collect()
        assert [tuple(r) for r in found] == [("b1_bid", [1.25, 1.25])]


def test_self_friend_gives_a_loop(spark):
    ratings = spark.createDataFrame([("u1", "b1", 1.0)], schemas.RATINGS)
    pairs = spark.createDataFrame([("u2", "b1")], schemas.PAIRS)
    users = spark.createDataFrame(
        [("u1", "u1, u2,None"), ("u2", "u1"), ("u3", "u1")], "user_id string, friends string"
    )
    found = sorted(map(tuple, graph.friend_edges(users, ratings, pairs).collect()))
    assert found == [("u1_uid", "u1_uid"), ("u1_uid", "u2_uid")]


def test_one_hot_keeps_width_for_unseen_values(spark):
    train = spark.createDataFrame([(0,), (1,), (None,)], "is_open int")
    values = matrix.learn_categories(train, "is_open")
    hot = matrix.one_hot(spark.createDataFrame([(5,), (1,)], "is_open int"), "is_open", values)
    assert sorted(tuple(r)[1:] for r in hot.collect()) == [(0, 0), (0, 1)]


def test_one_hot_of_very_many_values(spark):
    train = spark.range(5_000).select(F.format_string("c%04d", "id").alias("city"))
    fitted = matrix.fit_one_hot(train, "city")
    seen = spark.createDataFrame([("c0000",), ("c4999",), ("new",), (None,)], "city string")
    hot = {r["city"]: r["city_hot"] for r in matrix.one_hot_sparse(seen, "city", fitted).collect()}
    assert {v.size for v in hot.values()} == {5_000}
    assert {c: v.indices.tolist() for c, v in hot.items()} == {
        "c0000": [0], "c4999": [4_999], "new": [], None: []
    }


def test_holdout_rmse_counts_every_combination(spark):
    truth = spark.createDataFrame(
        [("u", "b", 1.0), ("u", "b", 5.0), ("u", "c", 2.0), ("x", "c", 2.0)],
        "user_id string, business_id string, stars double",
    )
    guess = spark.createDataFrame(
        [("u", "b", 2.0), ("u", "b", 4.0), ("u", "b", 4.5), ("u", "c", 3.0)],
        "user_id string, business_id string, prediction double",
    )
    joined = truth.join(guess, ["user_id", "business_id"])
    expected = evaluate.rmse(joined).first()
    found = evaluate.holdout_rmse(truth, guess).first()
    assert found["n"] == expected["n"] == 7
    assert found["rmse"] == pytest.approx(expected["rmse"])


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    found = sorted(map(tuple, matrix.standardise(df, df, ["a", "b"]).collect()))
    assert found == [(-1.0, 0.0), (1.0, 0.0)]
