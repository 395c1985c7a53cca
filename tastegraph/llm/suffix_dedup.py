"""Byte strings that occur twice, by suffix sorting with a difference cover.

The stretches of text that can hold a repeated string (see ``passages``) are
sorted shard by shard: suffixes at two of three places are sorted by triples,
names of equal triples are sorted again by the same method, the remaining
suffixes are merged in, and neighbours in the final order are compared over the
first bytes.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import covered, keyed, mix64, public_id
from tastegraph.llm.passages import Plan, repeated_windows

LENGTH = 400
#: Bytes of the gram that names a window, see ``passages``.
GRAM = 200
#: Names of a triple are packed into one number, which bounds the units sorted at once.
_BITS = 21


def suffix_order(units: np.ndarray) -> np.ndarray:
    """Places of a sequence of positive numbers in the order of the suffixes there."""
    n = len(units)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: units[i:].tolist()), np.int64)
    s = np.concatenate((units.astype(np.int64), np.zeros(3, np.int64)))
    # Two of three places; one beyond the end, if needed, closes the first list.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    triples = s[sample] << 2 * _BITS | s[sample + 1] << _BITS | s[sample + 2]
    order = np.argsort(triples)
    ordered = triples[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    if names[order[-1]] < len(sample):
        order = suffix_order(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]

    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(s[rest] << _BITS | rank[rest + 1])]

    def below(places: np.ndarray, key: Callable) -> np.ndarray:
        """How many of the sorted sample places come before each of the rest."""
        return np.searchsorted(key(places), key(rest))

    at = np.arange(len(rest))
    at += below(sampled[sampled % 3 == 1], lambda i: s[i] << _BITS | rank[i + 1])
    at += below(sampled[sampled % 3 == 2], lambda i: s[i] << 2 * _BITS | s[i + 1] << _BITS | rank[i + 2])
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = sampled
    return out


def repeated_strings(shard: list[tuple], length: int) -> list[np.ndarray]:
    """For each piece of bytes, which of its windows are also in another place."""
    pieces = [units for _, _, units in shard]
    sizes = np.array([len(p) + 1 for p in pieces])
    starts = np.cumsum(sizes) - sizes
    marks = len(pieces) + 1
    units = np.empty(sizes.sum(), np.int64)
    begins = np.zeros(len(units), bool)
    for k, (piece, start) in enumerate(zip(pieces, starts.tolist(), strict=True)):
        units[start : start + len(piece)] = piece.astype(np.int64) + marks
        units[start + len(piece)] = k + 1
        begins[start : start + len(piece) - length + 1] = True
    order = suffix_order(units)
    order = order[begins[order]]
    views = sliding_window_view(units.astype(np.uint16 if marks + 256 < 1 << 16 else np.int32), length)
    same = np.zeros(len(order), bool)
    for i in range(0, len(order) - 1, 4096):
        here = order[i : i + 4097]
        same[i : i + len(here) - 1] = (views[here[:-1]] == views[here[1:]]).all(axis=1)
    flags = np.zeros(len(units), bool)
    flags[order[same]] = True
    flags[order[1:][same[:-1]]] = True
    return [
        flags[start : start + len(piece) - length + 1]
        for piece, start in zip(pieces, starts.tolist(), strict=True)
    ]


def _reader():
    codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (lambda body: np.frombuffer(body, np.uint8)), codes.__getitem__


def plan(length: int = LENGTH, gram: int = GRAM) -> Plan:
    return Plan(length, gram, _reader, repeated_strings, later=False)


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans`` for every row of ``docs``.

    A byte goes if it lies in a string of ``length`` bytes that also starts at
    another place of any document, itself included. ``kept`` is what remains, as
    bytes. Null and empty texts and those shorter than ``length`` lose nothing.
    Rows with the same id and text are one document and get the same result; an
    empty table gives an empty result; other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    found = repeated_windows(rows, plan(length, gram))

    def run(batches):
        for batch in batches:
            out = []
            for body, starts, ends in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if not starts:
                    out.append((body, len(body), 0, 0))
                    continue
                gone = covered(len(body), starts, np.array(ends) + length - 1)
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((kept, len(body), int(gone.sum()), runs))
            columns = zip(*out, strict=True) if out else [()] * 4
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.record_batch([batch.column(0), *arrays], names=["id", "kept", "n_bytes", "n_removed", "n_spans"])

    marked = rows.join(found, ["id", "th"], "left").select("id", "body", "from", "to")
    kept = marked.mapInArrow(run, "id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return kept.select(public_id().alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans")
