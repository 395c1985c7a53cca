"""Lines that documents share with earlier ones, deleted where the two align.

A document is compared with earlier owners of its runs: from each line on, the fewest
consecutive lines that together have the words of a block. First with the first
owner of each run; then, for the runs that stay, with their next owners, until a
round deletes nothing. A pair is aligned by patience diff: lines that occur once on
either side and in the same order are anchors, and equal lines around them grow them
into blocks. Aligned blocks go from the later document.
"""

from bisect import bisect_left
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import RollingHash, batches_of, in_groups, text_bytes
from tastegraph.session import materialise


@dataclass(frozen=True)
class Settings:
    """``words``: what a run of lines needs to lead to a comparison, and a block to be deleted.

    ``rare``: a choice of cost over alignment that no query makes. Runs in more
    documents than it are not aligned, but go from all documents but their first
    owner. None aligns every line, however frequent.
    """

    words: int = 5
    rare: int | None = None


#: A word: characters between white space, or as many of them as a word may have. Scripts
#: that are written without spaces have their own lengths.
SCRIPTS = {r"[\p{Han}\p{Hiragana}\p{Katakana}]": 2, r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]": 4}
LONGEST_WORD = 24

#: Places of runs for each slice of a first owner; it decides only where pairs go.
SLICE_PLACES = 512


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


@cache
def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point (0 for white space) and the longest word of each class."""
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    classes = np.ones(0x110000, np.uint8)
    for k, pattern in enumerate((r"\p{White_Space}", *SCRIPTS)):
        found = "".join(regex.findall(pattern, everything))
        classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = k + 1 if k else 0
    return classes, np.array([1, LONGEST_WORD, *SCRIPTS.values()])


def line_words(texts: list[str], classes: np.ndarray, longest: np.ndarray) -> list[np.ndarray]:
    """The number of words of each line of each text, all texts in one pass."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    kind = classes[codes]
    first = np.flatnonzero(np.diff(kind, prepend=255))
    # Words begin every so many characters of a run of one class.
    sizes = np.diff(first, append=len(kind))
    words = np.where(kind[first] > 0, -(-sizes // longest[kind[first]]), 0)
    upto = np.concatenate(([0], np.cumsum(words)))
    breaks = np.flatnonzero(codes == 10)
    # A line break ends a run, so whole runs stand before it.
    counts = np.diff(upto[np.searchsorted(first, breaks, side="right") - (kind[breaks] == 0)], prepend=0)
    ends = np.cumsum([t.count("\n") + 1 for t in texts])
    return np.split(counts, ends[:-1])


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines of two texts, in order."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, m, j, n = open_.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        anchors = _longest_rising(_once(a, i, m), _once(b, j, n))
        if not anchors:
            continue
        for x, y in anchors:
            open_.append((i, x, j, y))
            found.append((x, y))
            i, j = x + 1, y + 1
        open_.append((i, m, j, n))
    return sorted(found)


def _once(lines: list[int], start: int, end: int) -> dict[int, int]:
    """Place of each line that occurs once in a range."""
    places: dict[int, int] = {}
    for k in range(start, end):
        places[lines[k]] = -1 if lines[k] in places else k
    return {line: k for line, k in places.items() if k >= 0}


def _longest_rising(a: dict[int, int], b: dict[int, int]) -> list[tuple[int, int]]:
    """The longest run of shared lines whose places rise on both sides."""
    pairs = sorted((k, b[line]) for line, k in a.items() if line in b)
    tops: list[int] = []
    piles: list[int] = []
    below: list[int] = []
    for n, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        below.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            piles.append(n)
        else:
            tops[pile], piles[pile] = y, n
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = below[n]
    return out[::-1]


def aligned_blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Lines of ``b`` in blocks aligned with ``a`` that have ``least`` words or more."""
    out, block, size = [], [], 0
    last = None
    for i, j in [*patience(a, b), (None, None)]:
        if last is not None and (i is None or (i, j) != (last[0] + 1, last[1] + 1)):
            if size >= least:
                out += block
            block, size = [], 0
        if i is not None:
            block.append(j)
            size += words[j]
            last = (i, j)
    return out


def duplicate_lines(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, th, gone``: the places of the lines to delete, for documents that lose any.

    A document is its id with the hash of its text; rows that share an id are
    never compared, and a null id comes before all others. "Earlier" is the
    smaller id. Lines are compared without the spaces around them; words are
    what stands between white space, in pieces of the length of a word.

    A run that stays after its first owner has been aligned is tried with the next
    one of another text. Every round makes at most one pair per run and document; a
    round that deletes nothing is the last.
    """
    texts = materialise(_texts(docs, id_col, text_col), "line_hashes")
    every = materialise(_runs(texts, settings.words), "line_runs")
    rare = settings.rare is not None
    owners = (
        every.groupBy("line")
        .agg(
            F.min(F.struct("id", "th")).alias("owner"),
            F.max("id").alias("last"),
            F.count("*").alias("uses"),
            *([F.count_distinct("id", "th").alias("owned")] if rare else []),
        )
        .where("owner.id < last")
        .select("line", "owner", "uses", *(["owned"] if rare else []))
    )
    open_, gone, deleted = every, None, 0
    while True:
        shared = _shared(open_, materialise(owners, "line_owners"))
        if rare and gone is None:
            common = shared.where(F.col("owned") > settings.rare)
            places = F.flatten(F.collect_list(F.sequence("place", "last_place")))
            gone = common.groupBy("id", "th").agg(F.array_distinct(places).alias("gone"))
            shared = shared.where(F.col("owned") <= settings.rare)
        found = _aligned(texts, shared, settings.words)
        gone = materialise(_united(found if gone is None else gone.union(found)), "gone_lines")
        now = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
        if now == deleted:
            return gone
        deleted = now
        stays = F.size(F.array_except(F.sequence("place", "last_place"), F.coalesce("gone", F.array().cast("array<int>")))) > 0
        open_ = materialise(
            shared.join(gone, ["id", "th"], "left").where(stays).select("id", "th", "line", "place", "last_place", "owner"),
            "open_lines",
        )
        tried = materialise(open_.groupBy("line").agg(F.max("owner").alias("tried"), F.count("*").alias("uses")), "tried_lines")
        open_ = open_.drop("owner")
        owners = (
            every.join(tried, "line")
            .where("id > tried.id and th != tried.th")
            .groupBy("line")
            .agg(F.min(F.struct("id", "th")).alias("owner"), F.max("uses").alias("uses"))
        )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, hashes, words``: the hash and the number of words of each line."""
    shared = docs.sparkSession.sparkContext.broadcast(character_classes())

    def run(batches):
        classes, longest = shared.value
        for batch in in_groups(batches, 3):
            held = [body.decode("utf-8", "replace") for body in batch.column(3).to_pylist()]
            words = pa.array(line_words(held, classes, longest), pa.list_(pa.int32()))
            yield pa.record_batch([*batch.columns[:3], words], names=["id", "th", "hashes", "words"])

    rows = docs.select(
        _key(id_col).alias("id"),
        _text_hash(F.col(text_col)).alias("th"),
        F.transform(_lines(F.col(text_col)), lambda x: F.xxhash64(F.trim(x))).alias("hashes"),
        text_bytes(text_col).alias("body"),
    )
    return rows.mapInArrow(run, "id long, th long, hashes array<long>, words array<int>")


def _shared(open_: DataFrame, owners: DataFrame) -> DataFrame:
    """The runs of documents with an earlier owner, and the slices that its pairs are dealt over."""
    slices = owners.groupBy("owner.id").agg(F.ceil(F.sum("uses") / SLICE_PLACES).alias("slices"))
    with_slices = owners.join(slices, F.col("owner.id") == slices["id"]).drop("id")
    return materialise(open_.join(with_slices, "line").where("id > owner.id"), "shared_lines")


def _runs(texts: DataFrame, least: int) -> DataFrame:
    """``id, th, line, place, last_place``: the run from each line that has words, by its hash.

    A line of ``least`` words is a run of its own. Equal blocks with as many words
    hold the run from their first line with words, so they lead to a comparison
    whatever the length of their lines.
    """
    names = ["id", "th", "line", "place", "last_place"]

    def run(batches):
        rolling = RollingHash(0)
        for batch in batches:
            hashes, words = batch.column(2), batch.column(3)
            sizes = np.diff(hashes.offsets.to_numpy())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.cumsum(sizes) - sizes
            sums = rolling.sums(hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            counts = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(counts)))
            end = np.searchsorted(upto, upto[:-1] + least)
            at = np.flatnonzero((counts > 0) & (end <= (starts + sizes)[doc]))
            end, doc = end[at], doc[at]
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(doc)),
                    batch.column(1).take(pa.array(doc)),
                    pa.array(rolling.spans(sums, at, end).view(np.int64)),
                    pa.array((at - starts[doc]).astype(np.int32)),
                    pa.array((end - 1 - starts[doc]).astype(np.int32)),
                ],
                names=names,
            )

    rows = texts.select("id", "th", "hashes", "words")
    return rows.mapInArrow(run, "id long, th long, line long, place int, last_place int")


def _united(found: DataFrame) -> DataFrame:
    """The places found for a document, of all its pairs together."""
    return found.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _aligned(texts: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """``id, th, gone`` for each pair of documents with lines to delete from the later.

    The pairs of an owner are dealt over slices, each with a copy of its lines.
    """
    slice_ = F.pmod(F.xxhash64("id", "th"), F.col("slices")).alias("slice")
    pairs = shared.select(F.col("owner.id").alias("first"), slice_, "id", "th").distinct()
    slices = shared.select(F.col("owner.id").alias("first"), "slices").distinct()
    earlier = (
        texts.select(F.col("id").alias("first"), F.col("hashes").alias("first_hashes"))
        .distinct()
        .join(slices, "first")
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        .drop("slices")
    )
    rows = pairs.join(earlier, ["first", "slice"]).join(texts, ["id", "th"])
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("gone", pa.list_(pa.int32()))])

    def run(batches):
        def each():
            for batch in batches:
                for k in range(batch.num_rows):
                    ident, th, a, b, words = (c[k].as_py() for c in batch.columns)
                    if gone := aligned_blocks(a, b, words, least):
                        yield ident, th, gone

        yield from batches_of(each(), schema)

    return rows.select("id", "th", "first_hashes", "hashes", "words").mapInArrow(run, "id long, th long, gone array<int>")


def remove_lines(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` as ``row``, with ``kept`` text and numbers of lines.

    Columns: ``row`` (a struct of all columns, as they were), ``kept``, ``n_lines``,
    ``n_removed``. Null and empty texts have one empty line, which stays; repeated
    rows get the same result; an empty table gives an empty result.
    """
    marked = docs.select(
        F.struct("*").alias("row"), _key(id_col).alias("id"), _text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("body")
    )
    rows = marked.join(duplicate_lines(docs, settings, id_col, text_col), ["id", "th"], "left")
    lines = _lines(F.col("body"))
    left = F.concat_ws("\n", F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)))
    return rows.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("body")).otherwise(left).alias("kept"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def drop_duplicate_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with their duplicate lines deleted, without documents that lose all words.

    The columns stay as they are but for ``text`` and, where present, ``n_chars``.
    """
    found = remove_lines(docs, settings).where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(
        *(
            F.when(F.col("n_removed") > 0, changed[c]).otherwise(F.col("row")[c]).cast(docs.schema[c].dataType).alias(c)
            if c in changed
            else F.col("row")[c].alias(c)
            for c in docs.columns
        )
    )
