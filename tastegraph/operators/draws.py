"""Tries of walkers whose node's neighbours are listed beside them, on arrays."""

import math
import sys
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need not have the package: these functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Digits of a digest that make one number: 13 of 4 bits.
_SCALE = 2.0**52
#: Where decimal numbers get longer.
_TENS = 10 ** np.arange(1, 19)

STATE = "walk_id bigint, step bigint, prev bigint, cur bigint, degree bigint"
SCHEMA = f"{STATE}, to bigint, info bigint, asked array<bigint>, asked_info array<bigint>"


_ROTATE = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_SINES = [np.uint32(int(abs(math.sin(k + 1)) * 2**32)) for k in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Messages hashed side by side, and the most bytes of one that fit a block of md5.
_TOGETHER = 1 << 14
_ONE_BLOCK = 55


def _digests(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two big-endian halves of the md5 of each row of bytes, all of one length."""
    n, length = text.shape
    block = np.zeros((n, 64), np.uint8)
    block[:, :length] = text
    block[:, length] = 0x80
    block[:, 56] = length * 8 & 0xFF
    block[:, 57] = length * 8 >> 8
    words = np.ascontiguousarray(block.view("<u4").T)
    empty = [not word.any() for word in words]
    state = [np.full(n, x, np.uint32) for x in _START]
    a, b, c, d = (x.copy() for x in state)
    f, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        if k < 16:
            g = k
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k < 32:
            g = (5 * k + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k < 48:
            g = (3 * k + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * k % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[k]
        if not empty[g]:
            f += words[g]
        turn = _ROTATE[k]
        np.right_shift(f, np.uint32(32 - turn), out=high)
        f <<= np.uint32(turn)
        f |= high
        f += b
        # The oldest word's array takes the next round's sum.
        a, d, c, b, f = d, c, b, f, a
    found = np.empty((n, 4), "<u4")
    for k, (x, y) in enumerate(zip(state, (a, b, c, d))):
        found[:, k] = x + y
    halves = found.view(">u8").astype(np.uint64)
    return halves[:, 0], halves[:, 1]


def numbers(seed: int, walk: np.ndarray, step: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers from 0 to 1 for each try, from the md5 of ``seed|walk|step|try``: the digest's
    first 13 hex digits and the next 13."""
    high, low = np.empty(len(walk), np.uint64), np.empty(len(walk), np.uint64)
    lead = np.frombuffer(b"%d|" % seed, np.uint8)
    for begin in range(0, len(walk), _TOGETHER):
        part = slice(begin, begin + _TOGETHER)
        values = [x[part] for x in (walk, step, tried)]
        # Messages of one layout at a time: so many digits for each number.
        sizes = [np.searchsorted(_TENS, x, side="right") + 1 for x in values]
        layout = (sizes[0] * 32 + sizes[1]) * 32 + sizes[2]
        kinds = np.unique(layout)
        for kind in kinds.tolist():
            at = slice(None) if len(kinds) == 1 else np.flatnonzero(layout == kind)
            widths = kind >> 10, kind >> 5 & 31, kind & 31
            own = [x[at] for x in values]
            text = np.empty((len(own[0]), len(lead) + sum(widths) + 2), np.uint8)
            text[:, : len(lead)] = lead
            end = len(lead)
            for k, (rest, width) in enumerate(zip(own, widths)):
                if k:
                    text[:, end] = ord("|")
                    end += 1
                for place in range(end + width - 1, end - 1, -1):
                    above = rest // 10
                    text[:, place] = rest - above * 10 + ord("0")
                    rest = above
                end += width
            if end <= _ONE_BLOCK:
                high[part][at], low[part][at] = _digests(text)
            else:
                halves = np.frombuffer(b"".join(md5(row.tobytes()).digest() for row in text), ">u8").reshape(-1, 2)
                high[part][at], low[part][at] = halves[:, 0], halves[:, 1]
    second = (high & np.uint64(0xFFF)) << np.uint64(40) | low >> np.uint64(24)
    return (high >> np.uint64(12)) / _SCALE, second / _SCALE


def first_drawn(num_walks: int, lowest: int, kind: str, q: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: from the ``node, degree`` of nodes with out-edges to ``cur, degree, pos,
    ks``, the positions that a node's walks draw at their first step, each with the numbers ``ks``
    of the walks that draw it. A node's walks are numbered from ``lowest``."""
    most = max(1.0, 1.0 / q)
    together = max(1, 8 * _TOGETHER // num_walks)
    ks = np.arange(num_walks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, together):
                part = batch.slice(begin, together)
                node, degree = (part[name].to_numpy() for name in ("node", "degree"))
                walk = (node[:, None] * num_walks + ks).ravel()
                none = np.zeros(len(walk), np.int64)
                u1, _ = numbers(seed, walk, none, none)
                many = np.repeat(degree, num_walks)
                pos = np.minimum(np.floor(u1 * (many * most) / most).astype(np.int64), many - 1)
                row = np.repeat(np.arange(len(node)), num_walks)
                # Walks of a node by position, in their order.
                order = np.lexsort((pos, row))
                pos = pos[order]
                new = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (row[1:] != row[:-1]))))
                ends = pa.array(np.append(new, len(pos)).astype(np.int32))
                numbered = pa.array((order % num_walks + lowest).astype(kind))
                arrays = [node[row[new]], degree[row[new]], pos[new]]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, arrays), pa.ListArray.from_arrays(ends, numbered)], names=["cur", "degree", "pos", "ks"]
                )

    return run


def outcome(rows: dict[str, np.ndarray], begin: np.ndarray, dst: np.ndarray, info: np.ndarray, p: float, q: float, seed: int):
    """Make tries until one is kept whatever the edges between ``prev`` and its target are.

    ``begin`` is where each walker's list of neighbours starts in ``dst`` and ``info``.
    Returns that target and its info, and the earlier tries that such an edge decides, in
    order, as walker, target and info.
    """
    most, extra = max(1.0, 1.0 / q), max(0.0, 1.0 / p - max(1.0, 1.0 / q))
    least, linked, far = min(1.0 / p, 1.0, 1.0 / q), 1.0, 1.0 / q
    to, to_info = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    asked = []
    left, tried = np.arange(len(begin)), rows["tried"].copy()
    while len(left):
        u1, u2 = numbers(seed, rows["walk_id"][left], rows["step"][left], tried[left])
        degree, prev = rows["degree"][left], rows["prev"][left]
        bound = degree * most
        x = u1 * (bound + np.where(rows["back"][left], extra, 0.0))
        back = x >= bound
        level = u2 * most
        pos = np.minimum(np.floor(np.where(back, u2 * degree, x / most)).astype(np.int64), degree - 1)
        place = begin[left] + pos
        target, target_info = dst[place], info[place]
        home = target == prev
        if_linked, if_far = level < linked, level < far
        sure = back | (degree == 1) | (level < least) | np.where(home, level < 1.0 / p, if_linked & if_far)
        # A straight return is along an edge that leads back.
        to[left[sure]] = np.where(back, prev, target)[sure]
        home_info = rows["prev_degree"][left] * 2 + 1
        to_info[left[sure]] = np.where(back, home_info, target_info)[sure]
        open_ = ~sure & ~home & (if_linked != if_far)
        asked.append((left[open_], target[open_], target_info[open_]))
        tried[left] += 1
        left = left[~sure]
    walker, target, target_info = (np.concatenate(parts) for parts in zip(*asked))
    order = np.argsort(walker, kind="stable")
    return to, to_info, walker[order], target[order], target_info[order]


def drawn(p: float, q: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows of a walker's state with ``dst`` and ``info``, to :data:`SCHEMA`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = ["walk_id", "step", "prev", "prev_degree", "cur", "degree", "back", "tried"]
            rows = {name: batch[name].to_numpy(zero_copy_only=False) for name in columns}
            offsets = batch["dst"].offsets.to_numpy()
            dst, info = (batch[name].flatten().to_numpy() for name in ("dst", "info"))
            to, to_info, walker, target, target_info = outcome(rows, offsets[:-1].astype(np.int64) - offsets[0], dst, info, p, q, seed)
            ends = np.concatenate(([0], np.cumsum(np.bincount(walker, minlength=len(to))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(values)) for values in (target, target_info)]
            arrays = [*(pa.array(rows[name]) for name in ("walk_id", "step", "prev", "cur", "degree")), pa.array(to), pa.array(to_info)]
            names = [column.split()[0] for column in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([*arrays, *lists], names=names)

    return run
