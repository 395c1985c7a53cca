"""Plans stay on the JVM, without cartesian products or needless scans."""

import pytest
from pyspark.sql import functions as F

from tastegraph.plans.catalog import QUERIES

RELATIONAL = [
    "eval_pairs_enriched", "train_pairs_enriched", "feature_matrix", "category_mean_vector",
    "edges", "pairs_with_both_vectors", "rmse_eval", "standardised_features",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_python_and_no_cartesian_product(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for forbidden in ("PythonUDF", "EvalPython", "InPandas", "CartesianProduct", "NestedLoop"):
        assert forbidden not in text


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(QUERIES["photo_count"](spark, sf_dir))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text


def test_matrix_without_variance_does_not_read_reviews(fx):
    from tastegraph.operators import features

    slim = features.enrich_pairs(fx.pairs, fx.business, fx.photo, fx.users)
    full = features.enrich_pairs(fx.pairs, fx.business, fx.photo, fx.users, fx.reviews)
    assert "var_pop" not in plan(slim) and "var_pop" in plan(full)


def test_edges_read_each_source_once(spark, fx, monkeypatch):
    """Ratings and pairs are read to store their ids, and not again for each family."""
    from tastegraph.operators import graph

    stored = []
    real = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: stored.append(df) or real(df, name))
    edges = graph.build_edges(fx.ratings, fx.pairs, fx.business, fx.users)
    assert len(stored) == 1
    text = plan(edges)
    assert "lineitem" not in text and text.count("FileScan parquet") <= 12


def test_salt_hashes_no_vector(spark):
    from tastegraph.operators.joins import salted_join

    left = spark.createDataFrame([(1, 2.0, [1.0, 2.0])], "k int, x double, vec array<float>")
    hot = spark.createDataFrame([(1, 4)], "k int, _slices int")
    right = spark.createDataFrame([(1, "a")], "k int, y string")
    text = plan(salted_join(left, right, ["k"], hot))
    hashed = [line for line in text.splitlines() if "xxhash64(" in line]
    assert hashed and not any("vec" in line.split("xxhash64(")[1].split(")")[0] for line in hashed)


def _above(lines, scan):
    """The first exchange or join above a scan, by depth of the tree."""
    depth = lines[scan].index("FileScan")
    for line in reversed(lines[:scan]):
        at = len(line) - len(line.lstrip(" :|+-*("))
        if at < depth:
            depth = at
            if "Exchange" in line or "Join" in line:
                return line
    return ""


def test_stored_vectors_are_not_shuffled(spark, fx):
    """A lookup by node takes the vectors as they lie; the asking ids move."""
    from tastegraph.functions import ids
    from tastegraph.operators import features, vectors

    stored = vectors.stored_by_node(fx.vectors)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = features.key_counts(fx.pairs, "user_id")
        found = features.attach_vector(keys, stored, ids.user_node(F.col("user_id")), "user_vec", 64)
        lines = plan(found).split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [k for k, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line]
    assert len(scans) == 1 and "Join" in _above(lines, scans[0]), "\n".join(lines)
    assert found.where("user_vec is null").count() == 0 and found.count() == keys.count()


def test_both_vectors_are_looked_up_in_buckets(spark, sf_dir):
    """Every scan of the store in the query is a bucketed one."""
    text = plan(QUERIES["pairs_with_stored_vectors"](spark, sf_dir))
    assert text.count("Bucketed: true") == 2 and "embeddings.parquet" not in text
