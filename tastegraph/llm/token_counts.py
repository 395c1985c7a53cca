"""Token counts of whole texts by a public tokenizer, without a shuffle.

A text falls into pre-tokens that the tokenizer never merges across, so its
count is the sum of theirs. Frequent pre-tokens have their lengths in a compact
table that is broadcast; others are encoded once per worker and kept in a
bounded cache.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import in_groups, sample_texts, text_bytes

#: Rows looked at for frequent pre-tokens (their beginnings), and entries in the
#: broadcast table. The table only saves time: pre-tokens that it lacks are encoded.
SAMPLE_ROWS = 4_000
TABLE_ENTRIES = 150_000
#: Entries a worker holds besides the table, and the longest pre-token worth one.
CACHE_ENTRIES = 300_000
LONGEST_KEPT = 64
#: Texts whose misses are encoded in one call.
GROUP = 64

_MARK = "\u2581"
_SPACED = re.compile(r" +[^ ]*")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    return public_tokenizers.path(name)


def pre_tokens(text: str) -> tuple[list[str], int]:
    """Keys of a text's pre-tokens, and its line breaks.

    The library puts a space before a text. A pre-token is a run of spaces with
    the word after it, written without its first space, or the word that begins
    a line, written after a line break.
    """
    keys, lines = [], (" " + text).split("\n")
    for line in lines:
        head, *words = line.split(" ")
        if head:
            keys.append("\n" + head)
        if "" in words:
            words = [p[1:] for p in _SPACED.findall(line)]
        keys += words
    return keys, len(lines) - 1


class PieceCounter:
    """Counts tokens as the library does, pre-token by pre-token."""

    def __init__(self, path: str, known: dict[str, int] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known = known or {}
        self.cache = dict(self.known)
        #: No piece holds a space mark after another character, nor a line break: then
        #: nothing is merged across pre-tokens. A model without this is run on whole texts.
        self.separable = not any(
            "\n" in p or re.search(f"[^{_MARK}]{_MARK}", p)
            for p in map(self.model.id_to_piece, range(self.model.get_piece_size()))
        )
        self.line_break = self.model.encode("\n")[-1]

    def lengths(self, keys: list[str]) -> list[int]:
        """Tokens of each pre-token, from one call over all of them."""
        joined = "".join(k if k[0:1] == "\n" else "\n " + k for k in keys)
        ids = np.array(self.model.encode(joined, num_threads=1))
        breaks = np.flatnonzero(ids == self.line_break)
        return (np.diff(np.append(breaks, len(ids))) - 1).tolist()

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.cache) > len(self.known) + CACHE_ENTRIES:
            self.cache = dict(self.known)
        cache, totals, fresh, open_ = self.cache, [], {}, []
        for text in texts:
            if not text:
                totals.append(0)
            elif not self.separable or _MARK in text:
                totals.append(len(self.model.encode(text, num_threads=1)))
            else:
                keys, breaks = pre_tokens(text)
                found = list(map(cache.get, keys))
                totals.append(breaks + sum(filter(None, found)))
                if None in found:
                    missed = [k for k, n in zip(keys, found, strict=True) if n is None]
                    fresh.update(dict.fromkeys(missed))
                    open_.append((len(totals) - 1, missed))
        if fresh:
            new = dict(zip(fresh, self.lengths(list(fresh)), strict=True))
            for i, missed in open_:
                totals[i] += sum(map(new.__getitem__, missed))
            cache.update((k, n) for k, n in new.items() if len(k) <= LONGEST_KEPT)
        return totals


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a bounded sample of rows."""
    found: Counter[str] = Counter()
    for text in sample_texts(docs, SAMPLE_ROWS, text_col):
        found.update(key for key in pre_tokens(text)[0] if len(key) <= LONGEST_KEPT)
    keys = [key for key, _ in found.most_common(TABLE_ENTRIES)]
    return dict(zip(keys, PieceCounter(path).lengths(keys), strict=True)) if keys else {}


def count_tokens(
    docs: DataFrame,
    path: str | None = None,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted
    each; an empty table gives an empty result; other columns are not read.
    """
    path = path or model_path()
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent_lengths(docs, path, text_col))

    def run(batches):
        counter = PieceCounter(path, known.value)
        for batch in in_groups(batches, 1):
            bodies = batch.column(1).to_pylist()
            counts = np.empty(len(bodies), np.int64)
            for i in range(0, len(bodies), GROUP):
                counts[i : i + GROUP] = counter.counts([b.decode() for b in bodies[i : i + GROUP]])
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
