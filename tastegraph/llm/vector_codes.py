"""Vector codes: parts of integer vectors replaced by the nearest codebook entry.

The entries of a part's codebook are sorted by component sum. By Cauchy's
inequality the squared distance of two vectors is at least the square of the gap
of their sums over the number of components, so a part looks at entries outward
from its own sum and stops on a side when that bound strictly exceeds its best
distance. All arithmetic is in integers; nothing depends on the order of rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import dealt_anew
from tastegraph.session import materialise


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


#: Bound of an integer component, so that squared distances fit 64 bits.
LARGEST = 1 << 26
#: Rows searched together.
GROUP = 8_192


class EqualAverage:
    """Nearest entries of one codebook by component sum."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.index = np.lexsort((np.arange(len(entries)), sums))
        self.entries, self.sums, self.dim = entries[self.index], sums[self.index], entries.shape[1]
        self.looked_at = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry, ties to the lower index."""
        n, size = len(parts), len(self.entries)
        own = parts.sum(axis=1)
        best = np.full(n, np.iinfo(np.int64).max)
        code = np.full(n, size, np.int64)
        up = np.searchsorted(self.sums, own)
        down = up - 1
        rows = np.arange(n)
        while len(rows):
            # Of the two next entries the one whose sum is nearer.
            high, low = up[rows], down[rows]
            gap_up = np.where(high < size, self.sums[np.minimum(high, size - 1)] - own[rows], LARGEST << 32)
            gap_down = np.where(low >= 0, own[rows] - self.sums[np.maximum(low, 0)], LARGEST << 32)
            upward = gap_up <= gap_down
            gap = np.where(upward, gap_up, gap_down)
            # Gaps beyond 2**31 are out of reach of any distance that fits.
            open_ = (gap < LARGEST << 32) & (np.minimum(gap, 1 << 31) ** 2 // self.dim <= best[rows])
            rows, upward = rows[open_], upward[open_]
            at = np.where(upward, high[open_], low[open_])
            apart = parts[rows] - self.entries[at]
            distance = np.einsum("ij,ij->i", apart, apart)
            index = self.index[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (index < code[rows]))
            best[rows[better]], code[rows[better]] = distance[better], index[better]
            up[rows[upward]] += 1
            down[rows[~upward]] -= 1
            self.looked_at += len(rows)
        return code, best


def _rows(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), np.int64).reshape(-1, width)


def integer_vectors(
    vectors: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, label, q`` of the rows whose vector is whole.

    ``q`` holds floor(scale * x), within +-2**26. Dropped are null and empty vectors,
    those with null or non-finite components and those whose length is not a
    multiple of the number of parts. Labels keep their type.
    """
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    bounded = F.transform(
        "vec",
        lambda x: F.least(
            F.greatest(F.floor(x * settings.scale).cast("long"), F.lit(-LARGEST)), F.lit(LARGEST)
        ).cast("int"),
    )
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec"))
        .where(F.col("vec").isNotNull() & (F.size("vec") > 0) & (F.size("vec") % settings.parts == 0))
        .where(finite)
        .select("vec_id", "label", bounded.alias("q"))
    )


def first_codebooks(rows: DataFrame, settings: Settings) -> np.ndarray | None:
    """The parts of the vectors with the smallest ids, as parts x entries x components.

    An id with several vectors gives its least one; null ids give none. Without any id
    there is no codebook. What reaches the driver is ``entries`` vectors.
    """
    seeds = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("q").alias("q"))
    found = [r.q for r in seeds.orderBy("vec_id").limit(settings.entries).collect()]
    if not found:
        return None
    alike = np.array([q for q in found if len(q) == len(found[0])], np.int64)
    return alike.reshape(len(alike), settings.parts, -1).transpose(1, 0, 2)


def _assigned(batch: pa.RecordBatch, books: list[EqualAverage]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts (rows x parts x components), codes and distances (rows x parts)."""
    width = books[0].dim
    q = _rows(batch, "q", len(books) * width).reshape(-1, len(books), width)
    codes, distances = zip(*(book.nearest(q[:, p]) for p, book in enumerate(books)), strict=True)
    return q, np.stack(codes, axis=1), np.stack(distances, axis=1)


def _books(shared: Broadcast) -> list[EqualAverage]:
    return [EqualAverage(entries) for entries in shared.value]


def trained_codebooks(rows: DataFrame, settings: Settings) -> np.ndarray | None:
    """The codebooks after all rounds.

    A round sums the parts by codebook position inside each task, then over tasks;
    the driver gets one row per used entry.
    """
    books = first_codebooks(rows, settings)
    if books is None:
        return None
    parts, entries, width = books.shape
    same = rows.where(F.size("q") == parts * width).select("q")
    context = rows.sparkSession.sparkContext
    for _ in range(settings.rounds):
        shared = context.broadcast(books)

        def sums(batches, shared=shared):
            own = _books(shared)
            total = np.zeros((parts * entries, width), np.int64)
            count = np.zeros(parts * entries, np.int64)
            for batch in batches:
                for begin in range(0, batch.num_rows, GROUP):
                    q, codes, _ = _assigned(batch.slice(begin, GROUP), own)
                    at = (codes + np.arange(parts) * entries).ravel()
                    np.add.at(total, at, q.reshape(-1, width))
                    count += np.bincount(at, minlength=len(count))
            used = np.flatnonzero(count)
            yield pa.record_batch(
                [pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
                names=["entry", "n", "total"],
            )

        partial = same.mapInArrow(sums, "entry long, n long, total array<long>")
        components = [F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)]
        books = books.copy().reshape(-1, width)
        for row in partial.groupBy("entry").agg(F.sum("n").alias("n"), *components).collect():
            books[row.entry] = [row[f"t{k}"] // row.n for k in range(width)]
        books = books.reshape(parts, entries, width)
        shared.unpersist()
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of integer vectors by given codebooks."""
    parts, _, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own = _books(shared)
        for batch in batches:
            for begin in range(0, batch.num_rows, GROUP):
                piece = batch.slice(begin, GROUP)
                _, codes, distances = _assigned(piece, own)
                text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.record_batch(
                    [piece.column(0), piece.column(1), pa.array(text), pa.array(distances.sum(axis=1))],
                    names=["vec_id", "label", "code", "error"],
                )

    kind = rows.schema["label"].dataType.simpleString()
    return (
        rows.where(F.size("q") == parts * width)
        .select("vec_id", "label", "q")
        .mapInArrow(run, f"vec_id long, label {kind}, code string, error long")
    )


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with the integer vector that its code stands for, as ``vector``."""
    book = F.array(*(F.array(*(F.array(*map(F.lit, e)) for e in part)) for part in books.tolist()))
    places = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    return codes.withColumn("vector", F.concat(*(book[p][place] for p, place in enumerate(places))))


def codebook_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compress(
    vectors: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray | None]:
    """``vec_id, code, error, label_error`` of every whole vector, and the codebooks.

    See :func:`integer_vectors` for the rows that are dropped; rows whose length is
    not that of the first codebook vector are dropped as well. Repeated rows are
    each coded and counted. ``label_error`` adds up the errors of a label, null
    labels together. Without a usable vector that has an id the result is empty and
    the codebooks are None.
    """
    rows = materialise(integer_vectors(vectors, settings, id_col, vec_col, label_col), "integers")
    books = trained_codebooks(rows, settings)
    if books is None:
        empty = "vec_id long, code string, error long, label_error long"
        return vectors.sparkSession.createDataFrame([], empty), None
    coded = materialise(encode(rows, books), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = by_label.select(F.col("label").alias("of_label"), "label_error")
    joined = coded.join(dealt_anew(by_label, "of_label"), F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error"), books
