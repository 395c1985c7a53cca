"""Toxicity scores: FTRL-proximal logistic regression over hashed word features.

A document's features are which words, word beginnings, word pairs and pairs
with one word between (skip-grams) it holds, hashed into a fixed space. Each
coordinate has its own learning rate, and the L1 term sets most weights to zero,
so that the model is small enough to broadcast.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import Memo, in_groups, mix64, text_bytes

_PUNCTUATION = b".,;:!?\"'()[]"


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the labelled rows learned from, picked by a hash of their id."""

    rows: int = 12_000
    bits: int = 22
    stem: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    epochs: int = 3
    threshold: float = 0.3


class Features:
    """Hashed features of texts."""

    def __init__(self, settings: Settings):
        self.mask = np.uint64((1 << settings.bits) - 1)
        self.shift = np.uint64(32)
        self.stem = settings.stem
        self.words = Memo(self._word, 150_000)

    def _word(self, word: bytes) -> int:
        """Hash of the word in the low half, of its beginning in the high half."""
        plain = word.strip(_PUNCTUATION).lower()
        start = xxhash.xxh32_intdigest(plain[: self.stem], 1)
        return start << 32 | xxhash.xxh32_intdigest(plain, 0)

    def all(self, text: bytes) -> np.ndarray:
        """Every feature of a text, with repeats; 0 is in every text."""
        words = text.split()
        codes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        spread = mix64(codes)
        pairs = mix64(spread[:-1] + np.uint64(3) * spread[1:])
        skips = mix64(spread[:-2] + np.uint64(5) * spread[2:])
        own = np.concatenate((codes, codes >> self.shift, pairs, skips)) & self.mask
        return np.append(own, np.uint64(0))


class Ftrl:
    """Follow the regularised leader, one example at a time.

    Coordinate 0 is the intercept: part of every example and free of L1.
    """

    def __init__(self, settings: Settings):
        self.s = settings
        self.z = np.zeros(1 << settings.bits, np.float32)
        self.n = np.zeros(1 << settings.bits, np.float32)

    def weights(self, i: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[i]
        rate = (s.beta + np.sqrt(self.n[i])) / s.alpha + s.l2
        l1 = np.where(i == 0, 0, s.l1)
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / rate)

    def learn(self, i: np.ndarray, label: int) -> None:
        w = self.weights(i)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        step = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.s.alpha
        self.z[i] += gradient - step * w
        self.n[i] = n + gradient * gradient

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """The coordinates with a weight, and the weights."""
        active = np.flatnonzero(np.abs(self.z) > self.s.l1)
        active = np.union1d([0], active)
        return active, self.weights(active)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept for testing: crc32 of the id as text, modulo 4, is 2."""
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


def learn_weights(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> dict:
    """Weights learned from at most ``settings.rows`` labelled documents.

    One task learns, since every step depends on the one before; the bound on
    rows keeps it small at any size of the corpus. Labels are joined by a list of
    at most that many ids, so no other text moves. An id with several labels
    takes the highest, one with several texts that of the least hash; null labels and
    ids are left out.
    """
    picked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).cast("long").alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(settings.rows)
    )
    rows = (
        docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_body"))
        .join(F.broadcast(picked), "_id")
        .groupBy("_id", "_label")
        .agg(F.min(F.struct(F.xxhash64("_body"), "_body"))["_body"].alias("_body"))
    )

    def train(batches):
        features, learner = Features(settings), Ftrl(settings)
        examples = [
            (np.unique(features.all(body)).astype(np.int32), label)
            for batch in in_groups(batches, 0)
            for body, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        ]
        for _ in range(settings.epochs):
            for i, label in examples:
                learner.learn(i, label)
        at, weights = learner.model()
        yield pa.record_batch(
            [pa.array(at, pa.int64()), pa.array(weights, pa.float64())], names=["at", "weight"]
        )

    learned = (
        rows.repartition(1)
        .sortWithinPartitions(F.xxhash64("_id"), "_id")
        .select("_body", "_label")
        .mapInArrow(train, "at long, weight double")
        .toPandas()
    )
    return {"at": learned["at"].to_numpy(), "weight": learned["weight"].to_numpy(), "settings": settings}


class Scorer:
    def __init__(self, settings: Settings, at: np.ndarray, weight: np.ndarray):
        self.features = Features(settings)
        self.table = np.zeros(1 << settings.bits, np.float32)
        self.table[at] = weight
        self.learned = bool(np.any(weight))

    def __call__(self, text: bytes) -> float:
        if not self.learned:
            return 0.0
        found = self.features.all(text)
        found = np.unique(found[self.table[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.table[found].sum(dtype=np.float64), -35, 35))))


def score(
    docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Scores come from the text alone. A text without known features, empty and
    null ones included, gets the score of the intercept; if nothing was learned
    every score is 0. Repeated rows are scored each; an empty table gives an empty
    result.
    """
    settings = model["settings"]
    threshold = settings.threshold
    shared = docs.sparkSession.sparkContext.broadcast((model["at"], model["weight"]))

    def run(batches):
        scorer = Scorer(settings, *shared.value)
        for batch in in_groups(batches, 2):
            scores = np.array([scorer(b) for b in batch.column(2).to_pylist()], np.float64)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(id_col).alias("held_out"),
        text_bytes(text_col).alias("body"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    settings = model["settings"]
    threshold = settings.threshold
    shared = docs.sparkSession.sparkContext.broadcast((model["at"], model["weight"]))

    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(settings, *shared.value)
        for batch in in_groups(batches, at):
            bodies = (b or b"" for b in batch.column(at).cast(pa.binary()).to_pylist())
            scores = np.array([scorer(b) for b in bodies], np.float64)
            yield batch.filter(pa.array(scores < threshold))

    # The text travels once: its bytes are taken from the column as it is.
    return docs.mapInArrow(run, docs.schema)
