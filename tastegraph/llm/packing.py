"""Token-budget batches inside length buckets that waste the least padding."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegraph.llm.token_counts import count_tokens
from tastegraph.session import materialise


@dataclass(frozen=True)
class Settings:
    """``budget`` tokens per batch, padding included, and ``buckets`` lengths to pad to.

    ``share`` rows at most, on average, are numbered by one task at a time.
    """

    budget: int = 65_536
    buckets: int = 16
    share: int = 20_000
    least_shares: int = 64


def bucket_lengths(histogram: dict[int, int], buckets: int) -> list[int]:
    """The lengths to pad to, at most ``buckets``, that need the fewest tokens in all.

    Dynamic programming over the distinct lengths: the best cost with k buckets up
    to a length is a minimum over where the last bucket begins, and for the
    lengths in order these candidates are lines whose lower hull is enough.
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    below = [0]
    for length in lengths:
        below.append(below[-1] + histogram[length])
    m = len(lengths)
    best = [0] + [None] * m
    starts = []
    for _ in range(min(buckets, m)):
        hull: list[int] = []  # places where the last bucket may begin, steepest last
        new, start, at = [0] + [None] * m, [0] * (m + 1), 0

        def value(i, x):
            return best[i] - x * below[i]

        def useless(a, b, c):
            """Whether line b is nowhere below both a and c."""
            return (best[c] - best[a]) * (below[b] - below[a]) <= (best[b] - best[a]) * (below[c] - below[a])

        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                while len(hull) - at >= 2 and useless(hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
            if len(hull) > at:
                x = lengths[j - 1]
                while at + 1 < len(hull) and value(hull[at + 1], x) <= value(hull[at], x):
                    at += 1
                new[j], start[j] = value(hull[at], x) + x * below[j], hull[at]
        starts.append((new[m], start))
        new[0] = None if starts else 0
        best = new
    use = min(range(len(starts)), key=lambda k: starts[k][0] if starts[k][0] is not None else float("inf"))
    ends, j = [], m
    for k in range(use, -1, -1):
        ends.append(lengths[j - 1])
        j = starts[k][1][j]
    return sorted(ends)


def pack(lengths: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """``doc_id, n_tokens, bucket_tokens, batch, slot`` for every row of ``lengths``.

    A bucket's batches hold as many texts as fit the budget at its length, and
    all but the last of a bucket are full. Texts above the budget are whole
    batches of their own, padded by nothing. Texts of no tokens share the first
    bucket, null lengths count as none, repeated rows are packed each, and an
    empty table gives an empty result.

    The histogram has at most one entry per length up to the budget, whatever the
    size of the corpus. Rows are numbered in many shares of every bucket, each
    starting where the counts of the shares before it end.
    """
    rows = materialise(
        lengths.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "lengths",
    )
    budget = settings.budget
    small = rows.where(F.col("n_tokens") <= budget).groupBy("n_tokens").agg(F.count("*").alias("n"))
    ends = bucket_lengths({r.n_tokens: r.n for r in small.collect()}, settings.buckets)
    shares = max(settings.least_shares, -(-rows.count() // settings.share))

    end = F.col("n_tokens")
    bucket = F.lit(len(ends))
    for k, length in reversed(list(enumerate(ends))):
        end = F.when(F.col("n_tokens") <= length, F.lit(length).cast("long")).otherwise(end)
        bucket = F.when(F.col("n_tokens") <= length, F.lit(k)).otherwise(bucket)
    placed = rows.select("*", bucket.alias("bucket"), end.alias("bucket_tokens")).withColumn(
        "share", F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int")
    )
    counts = placed.groupBy("bucket", "share").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket", "share").orderBy("row")
    ranked = placed.join(offsets, ["bucket", "share"]).withColumn(
        "rank", F.col("before") + F.row_number().over(within) - 1
    )
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    number = F.floor(F.col("rank") / fit).cast("long")
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket_tokens",
        F.concat_ws("-", "bucket", number).alias("batch"),
        F.pmod("rank", fit).cast("int").alias("slot"),
    )


def pack_documents(docs: DataFrame, settings: Settings = Settings(), path: str | None = None) -> DataFrame:
    """:func:`pack` over the token counts of whole texts."""
    return pack(count_tokens(docs, path), settings)
