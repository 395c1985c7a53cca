"""Near-duplicate documents by SimHash fingerprints and BK-trees.

Two fingerprints within three bits agree on one of four 16-bit blocks and, in
the other 48 bits, on one of four 12-bit blocks. Each distinct fingerprint goes
to the 16 shards named by these blocks, so that close ones meet in at least one
shard and unrelated ones hardly ever. A shard's fingerprints form a BK-tree
whose edges carry the distance to the parent; a query follows only edges within
the radius. Links are then joined into components.
"""

from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import batches_of, in_groups, text_bytes
from tastegraph.llm.components import connected_components
from tastegraph.session import materialise

SHINGLE = 3
RADIUS = 3
#: Fingerprints in one tree. A larger shard is cut into several trees, and each of
#: its fingerprints is looked up in all of them.
TREE_SIZE = 2_048
#: Hashes whose bits are counted at once.
_CHUNK = 16_384


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, 0 for a text without words."""
    words = body.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([hashed(joined[s:e], 42) for s, e in pairs], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, of every row."""

    def run(batches):
        for batch in in_groups(batches, 1):
            found = [fingerprint(b, shingle) for b in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=["doc_id", "fp"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def shard_keys(fp: Column) -> Column:
    """The 16 shards of a fingerprint: which blocks, and their bits."""
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << 16 * i) - 1)
        # Without the block; for the last one nothing lies above it.
        high = F.shiftrightunsigned(fp, 16 * (i + 1)) if i < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(high, 16 * i).bitwiseOR(low)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            key = F.shiftleft(block, 12).bitwiseOR(part)
            keys.append(F.shiftleft(key, 4).bitwiseOR(F.lit(4 * i + j).cast("long")))
    return F.array(*keys)


class BkTree:
    """Fingerprints under parents, keyed by the Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        while self.values:
            distance = (self.values[at] ^ value).bit_count()
            if distance == 0:
                return
            below = self.children[at].setdefault(distance, new)
            if below == new:
                break
            at = below
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> list[int]:
        """The nodes within the radius."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    open_.append(child)
        return found


def _linked(rows, radius: int):
    """(fp, root) for the fingerprints of each shard that are within the radius.

    ``rows`` are (shard, tree, own, fp) in this order: a tree's own fingerprints,
    then those that are only looked up in it.
    """
    for _, group in groupby(rows, key=lambda r: r[:2]):
        first = next(group)
        second = next(group, None)
        if second is None:
            continue
        tree, parent = BkTree(), {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for _, _, own, fp in chain((first, second), group):
            value = fp & 0xFFFFFFFFFFFFFFFF
            mine = parent.setdefault(fp, fp)
            for node in tree.near(value, radius):
                other = tree.values[node]
                other = root(other - (1 << 64) if other >> 63 else other)
                mine = root(mine)
                if other != mine:
                    parent[max(mine, other)] = min(mine, other)
            if own:
                tree.add(value)
        for fp in parent:
            if (top := root(fp)) != fp:
                yield fp, top


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Edges ``a, b`` that connect all distinct fingerprints ``fp`` within the radius.

    The edges of a shard span its groups of close fingerprints instead of
    listing all pairs.
    """
    if radius > 3:
        raise ValueError("the shards find distances of up to 3 bits")
    shards = fps.select(F.explode(shard_keys(F.col("fp"))).alias("shard"), "fp")
    large = materialise(
        shards.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tree_size),
        "large_shards",
    ).select("shard", F.ceil(F.col("n") / tree_size).cast("int").alias("trees"))
    placed = shards.join(large, "shard", "left").select(
        "shard",
        "fp",
        F.coalesce("trees", F.lit(1)).alias("trees"),
    )
    home = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    rows = (
        placed.withColumn("home", home)
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        .select("shard", "tree", (F.col("tree") == F.col("home")).alias("own"), "fp")
        .repartition("shard", "tree")
        .sortWithinPartitions("shard", "tree", F.desc("own"), "fp")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        def each():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        yield from batches_of(_linked(each(), radius), schema)

    return rows.mapInArrow(run, "a long, b long").distinct()


def simhash_components(
    docs: DataFrame,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that is reachable over fingerprints at
    most ``radius`` bits apart. Null, empty and blank texts have fingerprint zero
    and link like others; a null id is never the smallest unless all are null;
    repeated rows are returned each; an empty table gives an empty result.
    """
    found = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    first = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(fingerprint_links(first.select("fp"), radius))
    grouped = materialise(
        first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), "first"
        ),
        "grouped",
    )
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = grouped.join(least, "root").select("fp", "component_id")
    return found.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of each group, all columns as they were.

    Copies of one id and text are left once. In a group without any id, which has
    no smallest one, all texts stay.
    """
    kept = (
        simhash_components(docs, shingle, radius)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.col("doc_id").alias("kept"))
        .distinct()
    )
    marked = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_bytes()).alias("th")
    )
    return (
        marked.join(kept, F.col("id").eqNullSafe(F.col("kept")), "left_semi")
        .dropDuplicates(["id", "th"])
        .select("row.*")
    )
