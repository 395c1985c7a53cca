"""Salted joins give the plain join, also when one key holds most rows."""

import pytest
from pyspark.sql import functions as F

from tastegraph.operators import features, vectors
from tastegraph.operators.joins import assert_unique, hot_keys, ordered_index, skew_join


@pytest.fixture(scope="module")
def skewed(spark):
    # Key 0 has a third of all rows, most of them copies of one row.
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"),
    )
    right = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    return left, right


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_skew_join_equals_join(skewed, how):
    left, right = skewed
    found = skew_join(left, right, ["k"], how, hot_rows=100)
    plain = left.join(right, ["k"], how)
    assert found.columns == plain.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        map(tuple, plain.collect()), key=str
    )


def test_skew_join_repeats_right_duplicates(skewed):
    left, right = skewed
    twice = right.union(right)
    assert skew_join(left, twice, ["k"], "left", hot_rows=100).count() == (
        left.join(twice, ["k"], "left").count()
    )


def test_skew_join_spreads_copies(spark, skewed):
    """Copies of one row in several input partitions get several slices."""
    left, right = skewed
    hot = hot_keys(left.groupBy("k").count(), ["k"], "count", hot_rows=100)
    assert {r["k"]: r["_slices"] for r in hot.collect()}[0] > 1
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), "k", "v"), F.lit(10))
    copies = left.repartition(8).where("k = 0 and v = 7")
    assert copies.select(spread).distinct().count() > 1


def test_hot_list_is_bounded(skewed):
    left, _ = skewed
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    assert hot_keys(counts, ["k"], hot_rows=1, max_keys=5).count() == 5


def test_join_is_right_when_hot_list_is_cut(skewed, monkeypatch):
    """Keys that did not make the list are joined without slices."""
    left, right = skewed
    from tastegraph.operators import joins

    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, ["k"], hot_rows=1, max_keys=3)
    found = joins.salted_join(left, right, ["k"], hot, "left")
    assert found.count() == left.count()


def test_enriched_pairs_do_not_depend_on_salting(fx):
    def rows(hot_rows):
        found = features.enrich_pairs(
            fx.pairs, fx.business, fx.photo, fx.users, fx.reviews, hot_rows=hot_rows,
            user_vectors=fx.vectors, item_vectors=fx.vectors, vector_size=64,
        )
        return sorted(map(str, found.collect()))

    assert rows(1_000_000) == rows(5)


def test_side_scores_of_repeated_pairs(spark):
    pairs = spark.createDataFrame([("u", "b")] * 3 + [("v", "b")], "user_id string, business_id string")
    side = spark.createDataFrame([("u", "b", 4.0)], "user_id string, business_id string, score double")
    found = vectors.with_side_score(pairs, side).collect()
    assert sorted((r["user_id"], r["score"]) for r in found) == [("u", 4.0)] * 3 + [("v", 3.0)]


def test_ordered_index(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"))
    numbered = ordered_index(df.repartition(7), ["h"], F.substring("h", 1, 2), "at")
    rows = sorted((r["at"], r["h"]) for r in numbered.collect())
    assert [at for at, _ in rows] == list(range(500))
    assert [h for _, h in rows] == sorted(h for _, h in rows)


def test_assert_unique(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert_unique(df.distinct(), ["k"], "t")
    with pytest.raises(ValueError):
        assert_unique(df, ["k"], "t")
