"""Joins that keep working when one key holds a large share of the rows."""

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegraph import config
from tastegraph.functions.ids import poly_bucket


def hot_keys(
    counts: DataFrame,
    on: list[str],
    n: str = "n",
    hot_rows: int = config.HOT_ROWS,
    max_keys: int = config.MAX_HOT_KEYS,
    max_salts: int = config.MAX_SALTS,
) -> DataFrame:
    """The heaviest keys and the number of slices each is cut into.

    ``counts`` has one row per key with its row count in ``n``. The list holds
    at most ``max_keys`` rows, so it is safe to broadcast; any key left out has
    at most ``1 / max_keys`` of all rows. Which keys are on the list changes
    only how rows are spread, never which rows match.
    """
    return (
        counts.where(F.col(n) >= hot_rows)
        .orderBy(F.col(n).desc())
        .limit(max_keys)
        .select(
            *on,
            _slices(F.col(n), hot_rows, max_salts).alias("_slices"),
        )
    )


def _slices(n: Column, hot_rows: int, max_salts: int = config.MAX_SALTS) -> Column:
    """Number of slices for a key with ``n`` rows."""
    return F.least(F.lit(max_salts), F.ceil(n / hot_rows)).cast("int")


def _plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, VectorUDT))]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    hot: DataFrame,
    how: str = "left",
    right_slices: Column | None = None,
) -> DataFrame:
    """Equi-join where hot left keys are spread over several slices.

    ``hot`` comes from :func:`hot_keys`. Left rows of a hot key get a slice
    number, right rows of that key are repeated once per slice. Works for
    inner, left and left semi joins, which keep or drop each left row on its
    own. The slice mixes the input partition with the row's plain values, so
    copies of one row are spread too and a retried task gives the same slices;
    arrays such as vectors are left out, as they cost more than they spread.

    ``right_slices`` tells how often to repeat a right row where the right side
    already knows it (at least the number in ``hot``, or null for one);
    otherwise ``hot`` is joined to the right side too.
    """
    hot = F.broadcast(hot)
    spread = F.xxhash64(F.spark_partition_id(), *_plain_columns(left))
    salted_left = left.join(hot, on, "left").withColumn(
        "_salt",
        F.when(F.col("_slices").isNull(), 0)
        .otherwise(F.pmod(spread, F.col("_slices")))
        .cast("int"),
    ).drop("_slices")
    if right_slices is None:
        right = right.join(hot, on, "left")
    else:
        right = right.withColumn("_slices", right_slices)
    salted_right = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
    ).drop("_slices")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def counted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    counts: DataFrame,
    hot_rows: int = config.HOT_ROWS,
) -> DataFrame:
    """Left join to a table that carries the left side's row count per key.

    ``counts`` has the key and ``n``; ``right`` was built from it and still has
    ``n``. One aggregate then serves as key set, as list of hot keys and as
    repeat count, so its shuffle is planned once and reused.
    """
    slices = F.when(F.col("n") >= hot_rows, _slices(F.col("n"), hot_rows))
    return salted_join(
        left, right, on, hot_keys(counts, on, hot_rows=hot_rows), "left", slices
    ).drop("n")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    hot_rows: int = config.HOT_ROWS,
    counts_from: DataFrame | None = None,
) -> DataFrame:
    """:func:`salted_join` that counts the left keys itself.

    The count reads the key columns only and is combined before it is shuffled.
    When ``left`` is itself a join, ``counts_from`` names the table its keys
    come from, so that counting does not repeat that join.
    """
    counts = (left if counts_from is None else counts_from).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return salted_join(left, right, on, hot_keys(counts, on, hot_rows=hot_rows), how)


def assert_unique(df: DataFrame, on: list[str], name: str) -> None:
    """Raise when a key occurs twice, where a join would multiply rows."""
    repeated = df.groupBy(*on).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{name}: key {on} is not unique, e.g. {repeated[0]}")


def ordered_index(df: DataFrame, order: list[str | Column], bucket: Column, name: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... by ``order`` without sorting them in one task.

    ``bucket`` must grow with ``order`` and take a bounded number of values.
    Rows are numbered inside their bucket and shifted by the size of all lower
    buckets; only that short list of sizes is brought together.
    """
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    below = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        marked.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def placed_by_id(df: DataFrame, column: str, partitions: int = config.HASH_BUCKETS) -> DataFrame:
    """Rows in the partition that the polynomial hash of their id names; null ids in the first."""
    bucket = F.coalesce(poly_bucket(F.col(column), partitions), F.lit(0))
    return df.repartitionById(partitions, bucket.cast("int"))
