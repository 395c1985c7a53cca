"""What several operators need: reading tables, splitting words, hashing, keyed rows."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str | Column = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(text, F.lit("")).cast("binary")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``th`` (hash of the text) and ``body`` (its bytes) of each row.

    ``id`` and ``th`` together name a document. Rows that repeat both are one
    document and get one result; a null id sorts before all others.
    """
    body = text_bytes(text_col)
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"),
        F.xxhash64(body).alias("th"),
        body.alias("body"),
    )


def public_id(column: str = "id") -> Column:
    """The document id as it was read, null included."""
    return F.when(F.col(column) > F.lit(-(1 << 63)).cast("long"), F.col(column))


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """A table with one row per key, away from the partitions of its keys.

    A join with it by these keys shuffles both sides, and adaptive execution can
    split a hot key of the other side, which it cannot where an aggregate by the
    keys is joined in place.
    """
    return df.repartition(F.xxhash64(*keys))


#: Bytes of text that a worker turns into Python objects together.
GROUP_BYTES = 250_000


def in_groups(batches: Iterator[pa.RecordBatch], column: int, size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``size`` bytes of a binary column, or of one longer text.

    A batch is as large as Spark makes it; only the rows of a part should exist as
    Python objects at a time.
    """
    for batch in batches:
        begin = held = 0
        for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if k > begin and held + (n or 0) > size:
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += n or 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def sample_texts(docs: DataFrame, rows: int, text_col: str = "text", chars: int = 4_000) -> list[str]:
    """The first ``chars`` characters of some ``rows`` texts, for fitting alone.

    At most ``rows * chars`` characters reach the driver; Spark reads only as many
    files as it needs for them.
    """
    head = docs.select(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, chars).alias("head"))
    return [r.head for r in head.limit(rows).collect()]


class Memo(dict):
    """Values of a function by key, started anew when ``limit`` keys are held."""

    def __init__(self, function, limit: int):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of all stretches of a sequence, from prefix sums of powers modulo 2**64."""

    def __init__(self, seed: int):
        self.base = (0x9E3779B97F4A7C15 * (2 * seed + 1) | 1) & _MASK
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 4096)
            steps = np.full(size, self.base, np.uint64)
            back = np.full(size, self.inverse, np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.cumprod(steps), np.cumprod(back)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Prefix sums over well-mixed 64-bit codes."""
        n = len(codes)
        self._grow(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.up[:n], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each stretch [start, end)."""
        return mix64((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Hash of every stretch of the given length."""
        n = len(sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix64((sums[length:] - sums[:n]) * self.down[:n] + np.uint64(length))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def covered(n: int, starts, ends) -> np.ndarray:
    """Flags of the positions inside any [start, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches from an iterator of row tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
