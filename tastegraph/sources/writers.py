"""Sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws(" ", "src", "dst").alias("value"))


def write_edges(edges: DataFrame, path: str) -> None:
    edge_lines(edges).write.text(path)


def widen_vectors(vectors: DataFrame, size: int) -> DataFrame:
    """One column per dimension, as the exchange format needs."""
    return vectors.select(
        "id", *[F.col("embedding")[i].alias(f"E_{i}") for i in range(size)]
    )


def write_vectors(vectors: DataFrame, path: str, size: int) -> None:
    widen_vectors(vectors, size).write.option("header", True).csv(path)


def store_vectors(vectors: DataFrame, path: str, size: int) -> None:
    """Vectors as Parquet, or as a wide vector file if the path ends in ``.csv``."""
    if path.endswith(".csv"):
        write_vectors(vectors, path, size)
    else:
        vectors.write.parquet(path)


def write_ratings(ratings: DataFrame, path: str) -> None:
    """User, item and, where present, rating, with a header per file."""
    ratings.write.option("header", True).csv(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select("user_id", "business_id", "prediction").write.option(
        "header", True
    ).csv(path)
