"""Byte-level BPE: whole texts to token ids and back, without a shuffle.

Every character becomes a class, every class a transition function of a small
automaton. Composing functions is associative, so a batch of texts is cut into
blocks whose functions are found side by side and then composed in a scan; the
states around a character tell whether a pre-token begins there. Pre-tokens are
slices of the text's bytes; their merges are kept per worker in a bounded cache.
Each token's byte offset is kept beside its id, and decoding copies the
vocabulary's bytes to those offsets in one step.
"""

import base64
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import text_bytes

#: Entries that a worker holds, and the longest pre-token worth one.
CACHE_ENTRIES = 200_000
LONGEST_KEPT = 64
#: Bytes whose boundaries are searched together (a longer text is taken alone), and
#: characters of one block of the scan.
GROUP_BYTES = 250_000
BLOCK = 64

# The classes of characters and the states after them. The classes
# ONE (s, t, m, d), R, V, E and L are letters that contractions are made of.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, ONE, R, V, E, L, BREAK = range(12)
AT_START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK = range(6)
AFTER_QUOTE, AFTER_R, AFTER_V, AFTER_L, CONTRACTED = range(6, 11)
STATES = 11
CONTRACTION_LETTERS = {"s": ONE, "t": ONE, "m": ONE, "d": ONE, "r": R, "v": V, "e": E, "l": L}


def rank_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    return public_tokenizers.path(name)


def read_ranks(path: str) -> list[bytes]:
    """The token bytes in the order of their ranks."""
    with open(path, "rb") as lines:
        ranks = dict(line.split() for line in lines if line.strip())
    found = {int(rank): base64.b64decode(token) for token, rank in ranks.items()}
    return [found[rank] for rank in range(len(found))]


def transitions() -> np.ndarray:
    """The next state by class and state."""
    plain = {
        LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: AFTER_SPACE,
        BLANK: AFTER_BLANK, QUOTE: AFTER_QUOTE, BREAK: AT_START,
    }
    table = np.zeros((12, STATES), np.uint8)
    for kind in range(12):
        table[kind] = plain.get(kind, IN_LETTERS)
    # A quote begins a pre-token unless others or a space stand before it.
    table[QUOTE, [IN_OTHERS, AFTER_SPACE, AFTER_QUOTE]] = IN_OTHERS
    table[[ONE, R, V, L], AFTER_QUOTE] = [CONTRACTED, AFTER_R, AFTER_V, AFTER_L]
    table[E, [AFTER_R, AFTER_V]] = CONTRACTED
    table[L, AFTER_L] = CONTRACTED
    return table


@cache
def character_classes() -> np.ndarray:
    """The class of every code point, as the library's own pattern engine sees it.

    The engine is asked for all code points of a property at once; what it finds
    comes back as bytes. The table has one byte per code point.
    """
    import tiktoken

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        engine = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        members = bytes(engine.encode_ordinary(everything)).decode()
        classes[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    classes[ord(" ")] = SPACE
    classes[ord("'")] = QUOTE
    for letter, kind in CONTRACTION_LETTERS.items():
        classes[ord(letter)] = kind
    return classes


def scan_states(classes: np.ndarray, table: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The automaton's state after each character.

    Each block's function (end state by start state) is found for all blocks at
    once; a scan by doubling composes them; then all blocks run from their true
    start states.
    """
    n = len(classes)
    blocks = -(-n // block)
    padded = np.full(blocks * block, BREAK, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(blocks, block).T)
    flat, width = table.ravel(), np.intp(table.shape[1])
    function = np.broadcast_to(np.arange(table.shape[1], dtype=np.uint8), (blocks, table.shape[1]))
    for column in columns:
        function = flat[(column * width)[:, None] + function]
    step = 1
    while step < blocks:
        # Blocks [i - 2 step + 1, i] are those up to i - step, then those after.
        function = np.concatenate(
            (function[:step], np.take_along_axis(function[step:], function[:-step].astype(np.intp), axis=1))
        )
        step *= 2
    state = np.concatenate(([AT_START], function[:-1, AT_START])).astype(np.uint8)
    states = np.empty_like(columns)
    for k, column in enumerate(columns):
        state = flat[column * width + state]
        states[k] = state
    return states.T.ravel()[:n]


def boundaries(classes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Flags of the characters with which a pre-token (or a BREAK) begins."""
    states = scan_states(classes, table)
    before = np.concatenate(([AT_START], states[:-1]))
    after = np.concatenate((states[1:], [AT_START]))
    following = np.concatenate((classes[1:], [BREAK]))

    def among(values: np.ndarray, size: int, *members: int) -> np.ndarray:
        flags = np.zeros(size, bool)
        flags[list(members)] = True
        return flags[values]

    letter = among(classes, 12, LETTER, ONE, R, V, E, L)
    blank = among(classes, 12, SPACE, BLANK)
    joined = np.zeros(len(classes), bool)
    # Letters go on after letters and after a space; in a contraction after its quote.
    inside = among(before, STATES, IN_LETTERS, AFTER_R, AFTER_V, AFTER_L, AFTER_SPACE)
    opened = among(states, STATES, AFTER_R, AFTER_V, AFTER_L) & (after == CONTRACTED)
    inside |= (before == AFTER_QUOTE) & (opened | (states == CONTRACTED))
    joined |= letter & inside
    joined |= (classes == NUMBER) & among(before, STATES, IN_NUMBERS, AFTER_SPACE)
    joined |= among(classes, 12, OTHER, QUOTE) & among(before, STATES, IN_OTHERS, AFTER_QUOTE, AFTER_SPACE)
    # The last blank before other text stands alone or leads that text.
    last = ~among(following, 12, SPACE, BLANK, BREAK)
    joined |= blank & among(before, STATES, AFTER_SPACE, AFTER_BLANK) & ~last
    return ~joined


class Vocabulary:
    """Tokens, their mergeable pairs and the classes of characters; made once and broadcast."""

    def __init__(self, tokens: list[bytes], classes: np.ndarray):
        self.tokens, self.classes = tokens, classes
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        rank = {token: i for i, token in enumerate(tokens)}
        #: Every pair of tokens that is a token together, as one sorted number, and its rank.
        pairs = [
            (rank[token[:k]] * len(tokens) + rank[token[k:]], i)
            for i, token in enumerate(tokens)
            for k in range(1, len(token))
            if token[:k] in rank and token[k:] in rank
        ]
        self.pairs, self.pair_ranks = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()
        self.letters, self.begins = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.sizes) - self.sizes
        self._encoder = None

    def encoder(self) -> "Encoder":
        """The encoder of this process; tasks of a worker share its cache."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of tokens, each copied to its offset."""
        shift = np.repeat(self.begins[ids] - offsets, self.sizes[ids])
        return self.letters[np.arange(len(shift)) + shift].tobytes()


class Merger:
    """Merges the bytes of pre-tokens by rank; results are cached up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.rank = {token: i for i, token in enumerate(vocabulary.tokens)}
        self.sizes, self.none = vocabulary.sizes, len(vocabulary.tokens)
        self.pairs, self.pair_ranks = vocabulary.pairs, vocabulary.pair_ranks
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def learn(self, pieces: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The ids of pre-tokens that the cache lacks."""
        found, open_ = {}, {}
        for piece in pieces:
            whole = self.rank.get(piece)
            if whole is not None:
                found[piece] = (whole,)
            elif len(piece) > LONGEST_KEPT:
                found[piece] = self.merge_long(piece)
            else:
                # Pieces of like length are merged side by side.
                open_.setdefault(-(-len(piece) // 8) * 8, []).append(piece)
        for width, alike in open_.items():
            found.update(zip(alike, self.merge_short(alike, width), strict=True))
        if len(self.cache) + len(found) > CACHE_ENTRIES:
            self.cache.clear()
        self.cache.update((p, ids) for p, ids in found.items() if len(p) <= LONGEST_KEPT)
        return found

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.none + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], self.none)

    def merge_short(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """The lowest rank first, the leftmost of equals first, until no pair has one.

        Each step merges one pair of every piece that has any. A part stays at the
        place of its first byte; ``after`` and ``before`` are its neighbours' places.
        """
        m = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, m)
        letters = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = np.full((m, width + 1), -1, np.int64)
        ids[:, :width] = self.single[letters].reshape(m, width)
        ids[np.arange(width + 1)[None, :] >= sizes[:, None]] = -1
        ranks = np.full((m, width), self.none, np.int64)
        x, y = np.nonzero(ids[:, 1:] >= 0)
        ranks[x, y] = self._ranks_of(ids[x, y], ids[x, y + 1])
        after = np.tile(np.arange(1, width + 2), (m, 1))
        before = np.tile(np.arange(-1, width), (m, 1))
        rows = np.arange(m)
        while len(rows):
            at = np.argmin(ranks[rows], axis=1)
            best = ranks[rows, at]
            going = best < self.none
            rows, at, best = rows[going], at[going], best[going]
            gone = after[rows, at]
            right = after[rows, gone]
            ids[rows, at], ids[rows, gone] = best, -1
            ranks[rows, np.minimum(gone, width - 1)] = self.none
            after[rows, at] = right
            inner = right < sizes[rows]
            ranks[rows, at] = self.none
            r, a, b = rows[inner], at[inner], right[inner]
            before[r, b] = a
            ranks[r, a] = self._ranks_of(best[inner], ids[r, b])
            left = before[rows, at]
            inner = left >= 0
            r, a = rows[inner], left[inner]
            ranks[r, a] = self._ranks_of(ids[r, a], best[inner])
        flat = ids[ids >= 0].tolist()
        ends = np.cumsum((ids >= 0).sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for one piece of any length, by a heap of pairs."""
        rank, n = self.rank, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here, 0 once merged away
        back = list(range(-1, n))
        pairs = [(rank.get(piece[i : i + 2], -1), i, i + 2) for i in range(n - 1)]
        pairs = [p for p in pairs if p[0] >= 0]
        heapify(pairs)
        while pairs:
            _, i, stop = heappop(pairs)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of its parts has changed since
            end[i], end[middle] = stop, 0
            back[stop] = i
            if stop < n and (r := rank.get(piece[i : end[stop]], -1)) >= 0:
                heappush(pairs, (r, i, end[stop]))
            if i and (r := rank.get(piece[back[i] : stop], -1)) >= 0:
                heappush(pairs, (r, back[i], stop))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return tuple(out)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.merge, self.classes, self.table = Merger(vocabulary), vocabulary.classes, transitions()

    def encode(self, bodies: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and byte offsets of each text's tokens."""
        joined = "\0".join(b.decode() for b in bodies) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        widths = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        at = np.concatenate(([0], np.cumsum(widths)))
        ends = np.cumsum([len(b) + 1 for b in bodies]) - 1
        classes = self.classes[codes]
        classes[np.searchsorted(at, ends)] = BREAK
        starts = at[:-1][boundaries(classes, self.table)]
        data, cuts = joined.encode(), starts.tolist()
        firsts = np.searchsorted(starts, np.concatenate(([0], ends[:-1] + 1)))
        lasts = np.searchsorted(starts, ends)
        cached, slices, out = self.merge.cache.get, [], []
        for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
            own = cuts[first : last + 1]
            slices.append([data[a:b] for a, b in zip(own, own[1:], strict=False)])
        merged = [list(map(cached, pieces)) for pieces in slices]
        missed = {p for pieces, found in zip(slices, merged, strict=True) if None in found
                  for p, ids in zip(pieces, found, strict=True) if ids is None}
        fresh = self.merge.learn(list(missed)) if missed else {}
        for body, pieces, found in zip(bodies, slices, merged, strict=True):
            if None in found:
                found = [ids or fresh[p] for p, ids in zip(pieces, found, strict=True)]
            ids = np.fromiter(chain.from_iterable(found), np.int32)
            sizes = self.merge.sizes[ids]
            offsets = np.cumsum(sizes) - sizes
            out.append((ids, offsets.astype(np.int32)))
            assert not len(ids) or offsets[-1] + sizes[-1] == len(body)
        return out


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """First text and number of texts of runs of GROUP_BYTES in all, or one longer text."""
    first, held = 0, 0
    for k, size in enumerate(sizes):
        if k > first and held + size > GROUP_BYTES:
            yield first, k - first
            first, held = k, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes) - first


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """``doc_id, ids, offsets`` for every row of ``docs``.

    ``ids`` are the tokens of the whole text, ``offsets`` the byte at which each
    begins. Null and empty texts have none; bytes that are not UTF-8 count as the
    replacement character. Repeated rows are encoded each; an empty table gives an
    empty result; other columns are not read. What is broadcast is the vocabulary,
    its mergeable pairs and one byte per code point. With ``decoded`` the ids are
    decoded in the same pass and ``decoded`` takes the place of ``offsets``; see
    :func:`decode`.
    """
    vocabulary = Vocabulary(read_ranks(path or rank_path()), character_classes())
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    last = "decoded binary" if decoded else "offsets array<int>"

    def run(batches):
        vocabulary = shared.value
        encoder = vocabulary.encoder()
        for batch in batches:
            bodies = batch.column(1)
            for first, size in _groups(pc.binary_length(bodies).to_pylist()):
                own = [b.decode("utf-8", "replace").encode() for b in bodies.slice(first, size).to_pylist()]
                found = encoder.encode(own)
                end = pa.array([vocabulary.decode(*f) for f in found]) if decoded else _lists([o for _, o in found])
                yield pa.record_batch(
                    [batch.column(0).slice(first, size), _lists([ids for ids, _ in found]), end],
                    names=["doc_id", "ids", last.split()[0]],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, f"doc_id long, ids array<int>, {last}")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the bytes of its tokens as ``decoded`` in place of ``offsets``.

    Each token's bytes are copied to its offset. No tokens, or null, give no bytes;
    other columns stay.
    """
    vocabulary = Vocabulary(read_ranks(path or rank_path()), np.empty(0, np.uint8))
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c for c in encoded.columns if c not in ("offsets", "decoded")]

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            out = [
                vocabulary.decode(np.asarray(ids.values, np.int64), np.asarray(offsets.values, np.int64))
                if ids.is_valid and len(ids.values)
                else b""
                for ids, offsets in zip(batch.column("ids"), batch.column("offsets"), strict=True)
            ]
            columns = [batch.column(c) for c in names]
            yield pa.record_batch([*columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in names)
    return encoded.select(*names, "offsets").mapInArrow(run, f"{kept}, decoded binary")
