"""Which windows of a fixed length occur more than once, over all documents.

Each window is named by one of its short grams, the one with the least hash
(leftmost among equals), so that equal windows have the same gram at the same
distance. Windows side by side with the same gram form a stretch; the table of
stretches is a small part of the text. Only grams found at two places can hold a
repeated window, and where all stretches of a gram are equal they repeat as a
whole. What is left, grams with stretches that differ, goes gram by gram through
an exact structure over the stretches' content. A gram with very many different
stretches is split further, by its windows.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import RollingHash, dealt_anew, mix64
from tastegraph.session import drop_path, materialise

_ONE, _TWO = RollingHash(1), RollingHash(2)


@dataclass(frozen=True)
class Plan:
    """How to look for repeated windows of ``window`` units.

    ``reader`` makes, once per task, a function from a text's bytes to its units
    (numbers of a fixed type) and one from units to well-mixed 64-bit codes.
    ``later`` asks only for windows that also occur in a document with a smaller
    id; otherwise any other place counts. ``structure`` gets the stretches of
    one or several grams, as (gram, smallest id or place, units) in this order,
    and gives for each the flags of its repeated windows. ``crowd`` is the number
    of different stretches above which a gram is split by window, and ``chunk``
    the units that go through the structure at once.
    """

    window: int
    gram: int
    reader: Callable
    structure: Callable
    later: bool
    crowd: int = 64
    chunk: int = 1 << 18


def stretches(codes: np.ndarray, window: int, gram: int):
    """(gram hash, stretch hash, first window, end of windows) of a sequence of codes."""
    n = len(codes) - window + 1
    if n <= 0:
        return None
    hashes = _ONE.windows(_ONE.sums(codes), gram)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width, size = window - gram + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    end = np.append(first[1:], n)
    place = at[first]
    content = _TWO.spans(_TWO.sums(codes), first, end + window - 1)
    return hashes[place], mix64(content + (place - first).astype(np.uint64)), first, end


def window_names(codes: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit name of every window."""
    return _TWO.windows(_TWO.sums(codes), window)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _find_grams(rows: DataFrame, plan: Plan) -> DataFrame:
    """``id, th, gram, stretch, a, b``: the stretches of windows [a, b) of all documents."""
    names = ["id", "th", "gram", "stretch", "a", "b"]

    def run(batches):
        units, codes = plan.reader()
        for batch in batches:
            row, parts, size = [], [], 0

            def flush(batch=batch):
                at = pa.array(np.repeat(row, [len(p[0]) for p in parts]).astype(np.int64))
                gram, stretch, a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
                columns = [batch.column(0).take(at), batch.column(1).take(at), _long(gram), _long(stretch)]
                return pa.record_batch([*columns, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=names)

            for k, body in enumerate(batch.column(2).to_pylist()):
                if (found := stretches(codes(units(body)), plan.window, plan.gram)) is not None:
                    row.append(k)
                    parts.append(found)
                    size += len(found[0])
                if size > 100_000:
                    yield flush()
                    row, parts, size = [], [], 0
            if parts:
                yield flush()

    return rows.mapInArrow(run, "id long, th long, gram long, stretch long, a int, b int")


def _fetch(rows: DataFrame, contexts: DataFrame, plan: Plan) -> DataFrame:
    """The units of each different stretch."""
    wanted = contexts.groupBy("id", "th").agg(
        F.collect_list(F.struct("gram", "stretch", "a", "b", "least", "crowded")).alias("wanted")
    )
    names = ["crowded", "gram", "stretch", "least", "content"]
    types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        units, _ = plan.reader()
        for batch in batches:
            out, size = [], 0
            for body, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = units(body)
                for w in wanted:
                    content = own[w["a"] : w["b"] + plan.window - 1].tobytes()
                    out.append((w["crowded"], w["gram"], w["stretch"], w["least"], content))
                    size += len(content)
                if size > 4 << 20:
                    yield _record(out, types, names)
                    out, size = [], 0
            if out:
                yield _record(out, types, names)

    return (
        rows.join(wanted, ["id", "th"])
        .select("body", "wanted")
        .mapInArrow(run, "crowded boolean, gram long, stretch long, least long, content binary")
    )


def _record(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _shards(rows: Iterator[tuple], plan: Plan) -> Iterator[list[tuple]]:
    """Rows in chunks that end with a gram; a repeated stretch is taken once."""
    held, size, last = [], 0, None
    for gram, stretch, least, content in rows:
        if (gram, stretch) == last:
            continue
        if held and size > plan.chunk and gram != held[-1][0]:
            yield held
            held, size = [], 0
        last = gram, stretch
        held.append((gram, stretch, least, content))
        size += len(content)
    if held:
        yield held


def _compare(found: DataFrame, plan: Plan) -> DataFrame:
    """``gram, stretch, from, to``: runs of repeated windows, from the structure."""
    names = ["gram", "stretch", "from", "to"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches):
        units, _ = plan.reader()
        kind = units(b"").dtype

        def each():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for shard in _shards(each(), plan):
            content = [(gram, least, np.frombuffer(c, kind)) for gram, _, least, c in shard]
            out = []
            for (gram, stretch, _, _), flags in zip(shard, plan.structure(content, plan.window), strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
                if len(edges):
                    out.append((gram, stretch, edges[::2].tolist(), edges[1::2].tolist()))
            if out:
                yield _record(out, types, names)

    rows = found.where("not crowded").select("gram", "stretch", "least", "content")
    return (
        rows.repartition("gram")
        .sortWithinPartitions("gram", "least", "stretch")
        .mapInArrow(run, "gram long, stretch long, from array<int>, to array<int>")
    )


def _lead(codes: np.ndarray, width: int, gram: int) -> int:
    """Distance from the first window of a stretch to the gram that names it."""
    hashes = _ONE.windows(_ONE.sums(codes), gram)[:width] >> np.uint64(32)
    return int(np.argmin(hashes))


def _blocks(codes: np.ndarray, plan: Plan, size: int, parents: list[int] | None) -> Iterator[tuple]:
    """(block, core, hull, from, to) of a stretch's windows in blocks of ``size``.

    Windows are counted by their distance to the gram, so blocks of different
    stretches line up. The core is what all windows of a block have in common,
    the hull all that the block's windows in this stretch cover.
    """
    window, n = plan.window, len(codes) - plan.window + 1
    lead = _lead(codes, window - plan.gram + 1, plan.gram)
    low = lead - n + 1
    found = range(low // size, lead // size + 1)
    sums = _TWO.sums(codes)
    for k in found:
        if parents is not None and k // FAN not in parents:
            continue
        near, far = max(k * size, low), min((k + 1) * size - 1, lead)
        at = np.array([lead - k * size, lead - far])
        end = np.array([lead - (k + 1) * size + 1 + window, lead - near + window])
        core, hull = _TWO.spans(sums, at, end)
        hull = mix64(np.array([hull]) + np.uint64(near << 32 | far))[0]
        yield k, int(core.view(np.int64)), int(hull.view(np.int64)), lead - far, lead - near + 1


#: Blocks that a block is cut into.
FAN = 4


def _split(found: DataFrame, plan: Plan) -> DataFrame:
    """The same for crowded grams, by blocks of windows that are cut until they agree.

    A block whose hull is found again repeats as a whole. One whose core is not
    found again holds no repeated window. Others are cut, down to single windows,
    where core and hull are the same. So a stretch gives a few rows for each end
    of what it shares, and what very many stretches share is counted, not compared.
    """
    crowded = found.where("crowded").select("gram", "stretch", "least", "content").dropDuplicates(["gram", "stretch"])
    nothing = found.sparkSession.createDataFrame([], "gram long, stretch long, from array<int>, to array<int>")
    if crowded.isEmpty():
        return nothing
    names = ["gram", "stretch", "least", "block", "core", "hull", "from", "to"]
    types = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 2
    ddl = "gram long, stretch long, least long, block int, core long, hull long, from int, to int"
    size, levels = 1, []
    while size * FAN < plan.window - plan.gram + 1:
        size *= FAN
    rows = crowded.withColumn("parents", F.lit(None).cast("array<int>"))
    while size:

        def run(batches, size=size):
            units, codes = plan.reader()
            kind = units(b"").dtype
            for batch in batches:
                out = []
                for gram, stretch, least, content, parents in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = codes(np.frombuffer(content, kind))
                    out += [(gram, stretch, least, *b) for b in _blocks(own, plan, size, parents)]
                if out:
                    yield _record(out, types, names)

        blocks = materialise(rows.mapInArrow(run, ddl), "blocks")

        def ends(part: str, blocks=blocks):
            keys = ["gram", "block", part]
            least, most = F.min("least").alias(f"{part}_low"), F.max("least").alias(f"{part}_high")
            return dealt_anew(blocks.groupBy(*keys).agg(least, most), *keys)

        def again(part: str):
            return F.col(f"{part}_low") < F.col("least" if plan.later else f"{part}_high")

        known = blocks.join(ends("core"), ["gram", "block", "core"]).where("core_low < core_high")
        known = materialise(
            known.join(ends("hull"), ["gram", "block", "hull"]).select(
                *("gram", "stretch", "block", "core", "from", "to"),
                again("hull").alias("whole"),
                (again("core") & ~again("hull")).alias("open"),
                (~again("hull") | F.col("least").isin(F.col("hull_low"), F.col("hull_high"))).alias("stands"),
            ),
            "known",
        )
        levels.append(known.where("whole").select("gram", "stretch", "from", "to"))
        # An open block needs the others of its core beside it; equal ones stand for each other.
        open_ = dealt_anew(known.where("open").select("gram", "block", "core").distinct(), "gram", "block", "core")
        on = known.where("stands").join(open_, ["gram", "block", "core"], "left_semi")
        rows = crowded.join(on.groupBy("gram", "stretch").agg(F.collect_set("block").alias("parents")), ["gram", "stretch"])
        size //= FAN
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    spans = F.collect_list(F.struct("from", "to"))
    return every.groupBy("gram", "stretch").agg(spans.alias("spans")).select(
        "gram", "stretch", F.col("spans.from").alias("from"), F.col("spans.to").alias("to")
    )


def repeated_windows(rows: DataFrame, plan: Plan) -> DataFrame:
    """``id, th, from, to``: the repeated windows [from, to) of the documents that have any.

    ``rows`` has ``id``, ``th`` and ``body``; rows equal in the first two are one
    document. The windows found are exact up to hashes of 128 bits.
    """
    spark = rows.sparkSession
    place = F.col("id") if plan.later else F.xxhash64("id", "th", "a")
    grams, grams_path = materialise(_find_grams(rows, plan), "grams", with_path=True)
    twice = (
        grams.groupBy("gram")
        .agg(
            F.min(place).alias("low"),
            F.max(place).alias("high"),
            F.min("stretch").alias("one"),
            F.max("stretch").alias("other"),
        )
        .where("low < high")
        .select("gram", "low", (F.col("one") != F.col("other")).alias("mixed"))
    )
    hits = materialise(grams.join(materialise(twice, "twice"), "gram"), "hits")
    drop_path(spark, grams_path)

    differing = (
        hits.where("mixed")
        .groupBy("gram", "stretch")
        .agg(
            F.min(place).alias("least"),
            F.max(place).alias("most"),
            *(F.first(c).alias(c) for c in ("id", "th", "a", "b")),
        )
    )
    differing = materialise(differing, "differing")
    crowds = materialise(
        differing.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > plan.crowd).drop("n"), "crowds"
    )
    contexts = differing.join(crowds.withColumn("crowd", F.lit(True)), "gram", "left").withColumn(
        "crowded", F.coalesce("crowd", F.lit(False))
    )
    found = materialise(_fetch(rows, contexts, plan), "stretches")
    inner = _compare(found, plan).unionByName(_split(found, plan))
    by_stretch = materialise(
        differing.select("gram", "stretch", "least", "most").join(inner, ["gram", "stretch"], "left"), "repeats"
    )

    def spans(df: DataFrame, whole) -> DataFrame:
        one = lambda c: F.array(F.col(c))
        part = lambda c: F.transform(F.col(c), lambda x: x + F.col("a"))
        return df.select(
            "id",
            "th",
            F.when(whole, one("a")).otherwise(part("from")).alias("from"),
            F.when(whole, one("b")).otherwise(part("to")).alias("to"),
        ).where("from is not null")

    empty = F.lit(None).cast("array<int>")
    equal = hits.where("not mixed").withColumn("from", empty).withColumn("to", empty)
    mixed = hits.where("mixed").drop("low").join(by_stretch, ["gram", "stretch"])
    if plan.later:
        every = spans(equal, F.col("id") > F.col("low")).union(spans(mixed, F.col("id") > F.col("least")))
    else:
        every = spans(equal, F.lit(True)).union(spans(mixed, F.col("least") < F.col("most")))
    spans = F.collect_list(F.struct("from", "to"))
    return every.groupBy("id", "th").agg(spans.alias("spans")).select(
        "id", "th", F.flatten("spans.from").alias("from"), F.flatten("spans.to").alias("to")
    )
