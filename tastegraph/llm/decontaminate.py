"""Benchmark passages in documents, found by the q-gram lemma and aligned.

A passage that occurs with at most k edits shares a known number of its q-grams
with the text, all on diagonals that differ by at most 2k. Shared q-grams are
counted in overlapping bands of diagonals; bands that reach the number are
aligned within the band.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import batches_of, keyed, mix64, public_id, text_bytes

#: The longest q-gram used; shorter passages take what their edit budget allows.
Q = 12


@dataclass(frozen=True)
class Settings:
    """Edits allowed per character, the shortest passage that identifies a benchmark
    item, and the bytes of passages that are broadcast at a time."""

    edits: float = 0.05
    least: int = 20
    block_bytes: int = 16 << 20


def plain(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The text with small letters A-Z and single spaces, and each byte's place in the original."""
    raw = np.frombuffer(body.lower(), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    return np.where(space[at], 32, raw[at]).astype(np.uint8), at


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each place as one number: their bits, or beyond 8 bytes a hash."""
    n = len(text) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = text.astype(np.uint64)
    parts, width = [wide], 1
    while 2 * width <= min(q, 8):  # pairs, then fours, then eights
        last = parts[-1]
        parts.append(last[:-width] | last[width:] << np.uint64(8 * width))
        width *= 2
    if q == width:
        return parts[-1][:n]
    head, tail = parts[-1][:n], parts[-1][q - width : q - width + n]
    return mix64(head * np.uint64(0xD6E8FEB86659FD93) + tail)


class Passages:
    """An index of passages by their q-grams, for passages of one q."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray, int]]):
        self.q, self.items = q, items
        n = np.array([len(t) for _, t, _ in items])
        k = np.array([k for _, _, k in items])
        self.need, self.width = n + 1 - (k + 1) * q, 2 * k + 1
        codes = [grams(t, q) for _, t, _ in items]
        code = np.concatenate(codes)
        item = np.repeat(np.arange(len(items)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes])
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.code, self.first = np.unique(code[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(code)))
        #: Which codes can occur, by a few of their mixed bits: most of a text stops here.
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self._slot(self.code)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def bands(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) with enough shared q-grams; band b has diagonals b to b + 2 widths."""
        code = grams(text, self.q)
        at = np.flatnonzero(self.filter[self._slot(code)])
        found = np.searchsorted(self.code, code[at])
        found[found == len(self.code)] = 0
        hit = self.code[found] == code[at]
        at, found = at[hit], found[hit]
        times = self.count[found]
        total = int(times.sum())
        if not total:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        row = np.repeat(self.first[found] - np.cumsum(times) + times, times) + np.arange(total)
        item = self.item[row]
        band = (np.repeat(at, times) - self.place[row]) // self.width[item]
        low = 1 + int(band.min(initial=0))
        low = -min(low, 0) + 2
        span = int(band.max()) + low + 2
        key = np.concatenate((item * span + band + low, item * span + band + low - 1))
        key, shared = np.unique(key, return_counts=True)
        enough = shared >= self.need[key // span]
        key = key[enough]
        return key // span, key % span - low

    def matches(self, text: np.ndarray):
        """(item id, start, end, edits) of the passages in a text, places in the plain text."""
        whole = None
        for i, b in zip(*map(np.ndarray.tolist, self.bands(text)), strict=True):
            ident, passage, k = self.items[i]
            low = b * int(self.width[i]) - k
            high = low + 2 * int(self.width[i]) + 2 * k
            if whole is None:
                whole = text.tobytes()
            exact = whole.find(passage.tobytes(), max(low, 0), max(high + len(passage), 0))
            if exact >= 0:
                yield ident, exact, exact + len(passage), 0
            elif (found := banded(passage, text, low, high)) and found[2] <= k:
                yield ident, *found


def banded(passage: np.ndarray, text: np.ndarray, low: int, high: int):
    """(start, end, edits) of the best alignment of a passage on diagonals low to high.

    The alignment may begin and end anywhere in the text. Costs carry the
    diagonal of their start in the low bits, so that it comes out with the cost.
    """
    low, high = max(low, -len(passage)), min(high, len(text))
    if high < low:
        return None
    width = high - low + 1
    one = 1 << 32
    steps = np.arange(width, dtype=np.int64) * one
    places = np.arange(low, high + 1)
    padded = np.zeros(width + len(passage), np.int16) - 1
    own = np.arange(low, low + len(padded))
    inside = (own >= 0) & (own < len(text))
    padded[inside] = text[own[inside]]
    never = np.int64(1) << 60
    cost = np.where((places >= 0) & (places <= len(text)), np.arange(width, dtype=np.int64), never)
    for i in range(1, len(passage) + 1):
        cost_same = cost + one * (padded[i - 1 : i - 1 + width] != passage[i - 1])
        cost_same[padded[i - 1 : i - 1 + width] < 0] = never
        skip = np.append(cost[1:], never) + one
        new = np.minimum(cost_same, skip)
        new = np.minimum.accumulate(new - steps) + steps
        ends = places + i
        new[(ends < 0) | (ends > len(text))] = never
        cost = new
    best = int(np.argmin(cost))
    if cost[best] >= never:
        return None
    start = low + int(cost[best] & (one - 1))
    return start, low + best + len(passage), int(cost[best] >> 32)


def _indexes(rows: list, settings: Settings) -> list[Passages]:
    by_q: dict[int, list] = {}
    for ident, body in rows:
        text, _ = plain(body.strip())
        if len(text) < settings.least:
            continue
        k = int(len(text) * settings.edits)
        by_q.setdefault(min(Q, len(text) // (k + 1)), []).append((ident, text, k))
    return [Passages(q, items) for q, items in sorted(by_q.items())]


def _blocks(benchmark: DataFrame, settings: Settings, id_col: str, text_col: str):
    """The passages in blocks of bounded size, in the order of their ids."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("body"))
    rows = rows.where("id is not null").distinct()
    total = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = -(-total // settings.block_bytes) if total else 0
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        yield [(r.id, bytes(r.body)) for r in own.orderBy("id").collect()]


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, th, item_id, start, end, edits``: one row per passage and place in a document.

    Places are bytes of the whole text, ends exclusive; letters A-Z match in
    either case and any white space matches any. Passages shorter than
    ``settings.least`` and those with a null id identify nothing and are left
    out. Null and empty texts match nothing; a repeated document repeats its
    rows; without documents or passages the result is empty.
    """
    rows = keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    schema = pa.schema(
        [("id", pa.int64()), ("th", pa.int64())]
        + [(n, pa.int64()) for n in ("item_id", "start", "end")]
        + [("edits", pa.int32())]
    )
    ddl = "id long, th long, item_id long, start long, end long, edits int"
    found = spark.createDataFrame([], ddl)
    for block in _blocks(benchmark, settings, "item_id", "text"):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            indexes = _indexes(shared.value, settings)

            def each():
                for batch in batches:
                    for ident, th, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        text, at = plain(body)
                        spans = {m for index in indexes for m in index.matches(text)}
                        for item, start, end, edits in sorted(spans):
                            stop = int(at[end - 1]) + 1 if end > start else int(at[start - 1]) + 1
                            yield ident, th, item, int(at[min(start, len(at) - 1)]), stop, edits

            yield from batches_of(each(), schema)

        found = found.union(rows.mapInArrow(run, ddl))
    return found.select(public_id().alias("doc_id"), "th", "item_id", "start", "end", "edits")


def clean_documents(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, all columns as they were."""
    marked = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_bytes()).alias("th")
    )
    held = benchmark_matches(docs, benchmark, settings).select(F.col("doc_id").alias("bad"), F.col("th").alias("bad_th")).distinct()
    same = F.col("id").eqNullSafe(F.col("bad")) & (F.col("th") == F.col("bad_th"))
    return marked.join(held, same, "left_anti").select("row.*")
