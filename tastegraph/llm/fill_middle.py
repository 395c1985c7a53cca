"""Fill-in-the-middle: documents cut at hashed token positions and rearranged.

A rolling hash cuts every text into chunks by content, so passages that many
documents share fall into the same chunks. A chunk's summary (characters, token
starts, whether it begins and ends inside a word) is found once per worker and kept by
the chunk's hash; a kept summary is used only if the content is the same.
Adding up the counts of a document's chunks locates its cuts; only the chunks in
which a cut lies are looked into.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import RollingHash, in_groups, mix64, text_bytes


@dataclass(frozen=True)
class Settings:
    """Rates in percent, and the seed of the hash that draws from the document id."""

    seed: int = 1
    transformed: int = 90
    suffix_first: int = 20
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"


#: Bytes under the rolling hash, bits of it that must be zero at a chunk's end, and
#: bytes of the longest chunk. They change the chunks, never a result.
WINDOW = 32
CUT_BITS = 9
LONGEST = 8_192
#: Bytes a worker keeps for its summaries, what holds each of them included.
CACHE_BYTES = 32 << 20
SUMMARY_BYTES = 500

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _token_starts(chunk: np.ndarray) -> np.ndarray:
    """Byte places where a token begins: a letter after none, or any other character."""
    letter = _IS_LETTER[chunk]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    return np.flatnonzero(first | (~letter & ((chunk & 0xC0) != 0x80)))


@dataclass(frozen=True, slots=True)
class Summary:
    content: bytes
    chars: int
    starts: int
    letter_first: bool
    letter_last: bool


class Chunks:
    """Cuts bytes into chunks by content and keeps the summaries of those met before."""

    def __init__(self):
        self.hash = RollingHash(12)
        self.codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.kept: dict[int, Summary] = {}
        self.size = 0

    def cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places between chunks, 0 and every text's end included, and each chunk's hash.

        A chunk ends where the last WINDOW bytes hash to zero bits; a window never
        reaches into the text before, and no cut parts the bytes of a character.
        """
        sums = self.hash.sums(self.codes[data])
        hashes = self.hash.windows(sums, WINDOW)
        found = np.flatnonzero((hashes & np.uint64((1 << CUT_BITS) - 1)) == 0) + WINDOW
        begin = np.concatenate(([0], ends))[np.searchsorted(ends, found, side="left")]
        found = found[found - begin >= WINDOW]
        places = np.unique(np.concatenate(([0], found, ends)))
        gaps = np.diff(places)
        if (wide := np.flatnonzero(gaps > LONGEST)).size:
            more = [np.arange(places[i] + LONGEST, places[i + 1], LONGEST) for i in wide.tolist()]
            places = np.unique(np.concatenate([places, *more]))
        inside = np.zeros(len(places), bool)
        inside[:-1] = (data[places[:-1]] & 0xC0) == 0x80
        inside[np.isin(places, ends)] = False
        places = places[~inside]
        return places, self.hash.spans(sums, places[:-1], places[1:])

    def summary(self, key: int, content: bytes) -> Summary:
        known = self.kept.get(key)
        if known is not None and known.content == content:
            return known
        chunk = np.frombuffer(content, np.uint8)
        found = Summary(
            content,
            int(np.count_nonzero((chunk & 0xC0) != 0x80)),
            len(_token_starts(chunk)),
            bool(_IS_LETTER[chunk[0]]),
            bool(_IS_LETTER[chunk[-1]]),
        )
        if self.size > CACHE_BYTES:
            self.kept.clear()
            self.size = 0
        self.size += len(content) + SUMMARY_BYTES
        self.kept[key] = found
        return found


class Document:
    """A text as its chunks' summaries, with the tokens and characters before each."""

    def __init__(self, chunks: list[Summary]):
        self.chunks = chunks
        self.tokens, self.chars = [0], [0]
        in_word = False
        for c in chunks:
            # A word that goes on from the chunk before has begun there.
            self.tokens.append(self.tokens[-1] + c.starts - (in_word and c.letter_first))
            self.chars.append(self.chars[-1] + c.chars)
            in_word = c.letter_last

    @property
    def n(self) -> int:
        return self.tokens[-1]

    def place(self, units: int) -> tuple[int, int]:
        """Byte and character place after so many tokens."""
        if units >= self.n:
            return sum(len(c.content) for c in self.chunks), self.chars[-1]
        if units <= 0:
            return 0, 0
        k = int(np.searchsorted(self.tokens, units, side="right")) - 1
        chunk = np.frombuffer(self.chunks[k].content, np.uint8)
        own = _token_starts(chunk)
        going_on = k > 0 and self.chunks[k - 1].letter_last and self.chunks[k].letter_first
        at = int(own[units - self.tokens[k] + going_on])
        before = int(np.count_nonzero((chunk[:at] & 0xC0) != 0x80))
        return sum(len(c.content) for c in self.chunks[:k]) + at, self.chars[k] + before


def arranged(text: bytes, document: Document, draws: tuple[int, int, int, int], settings: Settings):
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    n = document.n
    marks = [m.encode() for m in (settings.prefix_mark, settings.suffix_mark, settings.middle_mark)]
    if not text or draws[2] % 100 >= settings.transformed or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    (a, chars_a), (b, chars_b) = document.place(first), document.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if draws[3] % 100 < settings.suffix_first:
        return n, "spm", chars_a, chars_b - chars_a, s + suffix + p + prefix + m + middle
    return n, "psm", chars_a, chars_b - chars_a, p + prefix + s + suffix + m + middle


def _draws(id_col: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the sha256 of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def rearranged(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`fill_in_middle` for batches of id, text and draws."""
    chunks = Chunks()
    for group in in_groups(batches, 1):
        body, *drawn = (c.to_pylist() for c in group.columns[1:])
        bodies = [b.decode("utf-8", "replace").encode() for b in body]
        rows = [
            arranged(text, document, draw, settings)
            for text, document, draw in zip(
                bodies, documents(bodies, chunks), zip(*drawn, strict=True), strict=True
            )
        ]
        n, form, prefix, middle, output = zip(*rows, strict=True)
        yield pa.record_batch(
            [
                group.column(0),
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()),
                pa.array([o.decode() for o in output], pa.string()),
            ],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def fill_in_middle(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    ``n`` counts the tokens ``[A-Za-z]+|[^A-Za-z]``. Null and empty texts have none
    and stay plain; so do texts that hold a mark. A null id draws as the empty
    string. Bytes that are not UTF-8 count as the replacement character. Repeated
    rows are rearranged each; an empty table gives an empty result; other columns
    are not read.
    """

    def run(batches):
        return rearranged(batches, settings)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"), *_draws(F.col(id_col).cast("long"), settings.seed)
    ).toDF("doc_id", "body", "h1", "h2", "h3", "h4")
    return rows.mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def documents(bodies: list[bytes], chunks: Chunks) -> list[Document]:
    """Each text as its chunks' summaries; the texts are hashed together."""
    data = b"".join(bodies)
    ends = np.cumsum([len(b) for b in bodies])
    if not data:
        return [Document([]) for _ in bodies]
    places, hashes = chunks.cut(np.frombuffer(data, np.uint8), np.unique(ends[ends > 0]))
    at, keys = places.tolist(), hashes.tolist()
    found = [chunks.summary(key, data[a:b]) for key, a, b in zip(keys, at, at[1:], strict=False)]
    lasts = np.searchsorted(places, ends).tolist()
    return [Document(found[a:b]) for a, b in zip([0, *lasts], lasts, strict=False)]


def restore(arranged_docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``arranged_docs`` with the text rebuilt from ``output`` and ``form`` as ``restored``.

    The marks occur once each in an output that is not plain, so the parts are what
    stands between them. A null output gives null.
    """
    p, s, m = (re.escape(x) for x in (settings.prefix_mark, settings.suffix_mark, settings.middle_mark))

    order = {"psm": (p, s, m, "$1$3$2"), "spm": (s, p, m, "$2$3$1")}
    text = F.col("output")
    for form, (first, second, third, parts) in order.items():
        pattern = f"(?s)\\A{first}(.*?){second}(.*?){third}(.*)\\z"
        text = F.when(F.col("form") == form, F.regexp_replace("output", pattern, parts)).otherwise(text)
    return arranged_docs.withColumn("restored", text)
