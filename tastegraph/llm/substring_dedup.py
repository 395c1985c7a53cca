"""Word sequences that occur earlier, by suffix automata and matching statistics.

The stretches of text that can hold a repeated sequence (see ``passages``) come
shard by shard, in the order of their documents. Each is streamed through the
suffix automaton of those before it: where the longest match that ends at a word
is long enough, the sequence has occurred. Then it joins the automaton.
"""

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tastegraph.llm.common import Memo, covered, keyed, public_id
from tastegraph.llm.passages import Plan, repeated_windows, window_names

WORDS = 20
#: Words of the gram that names a window, see ``passages``.
GRAM = 8


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _divide(self, state: int, unit: int, target: int) -> int:
        """A state for the part of ``target`` that is reached from ``state``."""
        twin = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while state >= 0 and self.next[state].get(unit) == target:
            self.next[state][unit] = twin
            state = self.link[state]
        return twin

    def add(self, units: list[int]) -> None:
        last = 0
        for unit in units:
            target = self.next[last].get(unit)
            if target is not None:
                exact = self.length[target] == self.length[last] + 1
                last = target if exact else self._divide(last, unit, target)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            state = last
            while state >= 0 and unit not in self.next[state]:
                self.next[state][unit] = new
                state = self.link[state]
            if state >= 0:
                target = self.next[state][unit]
                exact = self.length[target] == self.length[state] + 1
                self.link[new] = target if exact else self._divide(state, unit, target)
            last = new

    def statistics(self, units: list[int]) -> np.ndarray:
        """For each place, the length of the longest substring that ends there."""
        out, state, length = np.empty(len(units), np.int64), 0, 0
        for i, unit in enumerate(units):
            while state and unit not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if unit in self.next[state]:
                state, length = self.next[state][unit], length + 1
            out[i] = length
        return out


def earlier_sequences(shard: list[tuple], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows are in a piece with a smaller id."""
    out = []
    for _, pieces in groupby(shard, key=lambda p: p[0]):
        automaton = SuffixAutomaton()
        for _, same_id in groupby(pieces, key=lambda p: p[1]):
            units = [p[2].tolist() for p in same_id]
            out += [automaton.statistics(u)[length - 1 :] >= length for u in units]
            for u in units:
                automaton.add(u)
    return out


def _reader():
    words = Memo(lambda word: xxhash.xxh64_intdigest(word, 7), 150_000)

    def units(body: bytes) -> np.ndarray:
        found = body.split()
        return np.fromiter(map(words.__getitem__, found), np.uint64, len(found))

    return units, lambda codes: codes


def plan(length: int = WORDS, gram: int = GRAM) -> Plan:
    return Plan(length, gram, _reader, earlier_sequences, later=True)


def repeats_inside(names: np.ndarray) -> np.ndarray:
    """Flags of the windows that start earlier in the same document."""
    again = np.ones(len(names), bool)
    again[np.unique(names, return_index=True)[1]] = False
    return again


def remove_repeats(
    docs: DataFrame,
    length: int = WORDS,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, kept, n_words, n_removed`` for every row of ``docs``.

    A word goes if it lies in ``length`` consecutive words that also start
    earlier: in a document with a smaller id, or before in the same one. ``kept``
    is the remaining words, joined by single spaces, as bytes. Null and empty
    texts have no words. A null id comes before all others; rows with the same id
    and text are one document and get the same result, and documents that share
    an id are not compared; an empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    found = repeated_windows(rows, plan(length, gram))

    def run(batches):
        units, _ = _reader()
        for batch in batches:
            out = []
            for body, starts, ends in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                words = body.split()
                gone = np.zeros(len(words), bool)
                if starts:
                    gone |= covered(len(words), starts, np.array(ends) + length - 1)
                inside = np.flatnonzero(repeats_inside(window_names(units(body), length)))
                if len(inside):
                    gone |= covered(len(words), inside, inside + length)
                n = int(gone.sum())
                left = words if not n else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((b" ".join(left), len(words), n))
            columns = zip(*out, strict=True) if out else [()] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.int64(), pa.int64()], strict=True)]
            yield pa.record_batch([batch.column(0), *arrays], names=["id", "kept", "n_words", "n_removed"])

    marked = rows.join(found, ["id", "th"], "left").select("id", "body", "from", "to")
    kept = marked.mapInArrow(run, "id long, kept binary, n_words long, n_removed long")
    return kept.select(public_id().alias("doc_id"), "kept", "n_words", "n_removed")
