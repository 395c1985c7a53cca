"""Readers for the input files and for the engine's own text outputs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegraph.sources import schemas


def drop_header_lines(lines: DataFrame, header: str) -> DataFrame:
    """Remove every line equal to ``header``, wherever it stands."""
    return lines.where(F.col("value") != header)


def _read_delimited(spark: SparkSession, path: str, columns: str, header: str | None) -> DataFrame:
    """Comma-separated lines without quoting, header lines removed everywhere.

    The header is the line of the column names unless another is given. Files of
    a folder may have it or not, but at least one must: otherwise the real header
    is a different line and would be read as data.
    """
    schema = T.StructType.fromDDL(columns)
    header = header or ",".join(schema.names)
    lines = spark.read.text(path)
    if lines.where(F.col("value") == header).isEmpty() and not lines.isEmpty():
        found = lines.first()["value"]
        raise ValueError(f"no header line {header!r} in {path}; a line there is {found!r}")
    piece = F.split("value", ",")
    return drop_header_lines(lines, header).select(
        *[piece[i].cast(field.dataType).alias(field.name) for i, field in enumerate(schema)]
    )


def read_ratings(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """Known ratings."""
    return _read_delimited(spark, path, schemas.RATINGS, header)


def read_pairs(
    spark: SparkSession, path: str, header: str | None = None, with_stars: bool = False
) -> DataFrame:
    """Pairs to score; ``with_stars`` also reads the known rating for evaluation.

    Further columns may follow in the file; then ``header`` must be given.
    """
    return _read_delimited(spark, path, schemas.RATINGS if with_stars else schemas.PAIRS, header)


def _read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is not JSON stops the job instead of becoming nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_business(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, path, schemas.BUSINESS)


def read_photo(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, path, schemas.PHOTO)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, path, schemas.REVIEWS)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, path, schemas.USERS)


def read_vectors(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Wide vector file (id, E_0 .. E_n) as ``id, embedding``.

    Parquet with an array column is the better store, see :func:`load_vectors`;
    this reads the exchange format.
    """
    names = [f"E_{i}" for i in range(size)]
    schema = "id string, " + ", ".join(f"{name} float" for name in names)
    wide = spark.read.schema(schema).option("header", True).csv(path)
    return wide.select("id", F.array(*names).alias("embedding"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated edge lines as ``src, dst``; extra fields are ignored."""
    piece = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(path)
        .where(F.size(piece) >= 2)
        .select(piece[0].alias("src"), piece[1].alias("dst"))
    )


def load_vectors(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Vectors in either form: a path that ends in ``.csv`` is a wide vector file."""
    return read_vectors(spark, path, size) if path.endswith(".csv") else spark.read.parquet(path)
