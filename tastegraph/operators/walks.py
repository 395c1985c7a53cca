"""Second-order biased random walks as rounds of joins.

A walker at ``cur`` that came from ``prev`` moves to an out-neighbour ``x`` of
``cur`` with weight ``1/p`` if ``x`` is ``prev``, ``1`` if ``prev -> x`` is an
edge, and ``1/q`` otherwise (Grover and Leskovec, node2vec, 2016).

Listing all neighbours of all walkers would cost walkers x degree at a hub.
Instead each walker draws neighbours by position and keeps or rejects them, so
the cost per step does not depend on the degree:

* out-neighbours of a node are numbered 0 .. degree-1, and a draw looks up one
  ``(node, position)`` row, which also spreads the rows of a hub;
* with ``m = max(1, 1/q)``, a draw is kept with probability ``weight / m``;
* the part of ``1/p`` above ``m`` is put aside as extra mass that goes straight
  back to ``prev``, so a small ``p`` does not lower the acceptance rate.

All draws come from ``md5(seed|walk|step|try)``. A walk is a function of its
number alone, whatever the partitioning, the batch of tries or a lost executor.
Nodes of few out-edges have them listed in one row each. A walker that stands at such a
node and came from one makes all its tries beside that list, and those that an edge from
``prev`` decides are asked of the list of ``prev``: two shuffles of one row per walker.
All others, and those at a node that holds too many walkers, make tries as rows.
The edge tables lie in buckets, by (node, position) for the lookup, by (source, target)
for the edge test and by node for the lists, so a round shuffles tries and never an edge. A (node,
position) that more tries ask for than a task should hold is looked up in a broadcast
list, which has at most one row per ``hot_rows`` tries.
Walkers do not wait for each other: in a round each makes some tries, moves if
one is kept, and goes on with later tries if none is. Each round is written to
the scratch folder; those files are also the record of all visits. The first step is
one round for all, kept by edge with the walks that take it.
"""

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tastegraph import config
from tastegraph.functions.ids import hex_number
from tastegraph.operators import draws, graph
from tastegraph.operators.joins import hot_keys, ordered_index, salted_join, skew_join
from tastegraph.session import bucketed, freed_shuffles, materialise, scratch_path


@dataclass
class WalkGraph:
    """A graph prepared for walking; the first three tables lie in the scratch folder."""

    nodes: DataFrame      # id, node
    links: DataFrame      # src, dst, as node numbers, distinct; in buckets of both
    neighbours: DataFrame  # src, pos, dst, degree (of dst), back (dst -> src exists); in buckets of src, pos
    starts: DataFrame     # node, degree
    n_nodes: int
    lists: DataFrame      # src, dst, info (degree and back) of nodes with few out-edges, in order of pos; in buckets of src


def number_nodes(edges: DataFrame) -> DataFrame:
    """Dense node numbers in the order of the ids' md5.

    Numbers are shorter to shuffle than ids, and the order scatters nodes
    evenly over any range of numbers.
    """
    hashed = graph.graph_nodes(edges).withColumn("_md5", F.md5(F.col("id").cast("binary")))
    return ordered_index(hashed, ["_md5", "id"], F.substring("_md5", 1, 4), "node").drop("_md5")


def number_neighbours(
    links: DataFrame,
    degrees: DataFrame,
    n_nodes: int,
    hot_rows: int = config.HOT_ROWS,
) -> DataFrame:
    """Position of each edge among the edges of its source, in order of ``dst``.

    A hub's neighbours are numbered in ranges of ``dst`` of about ``hot_rows``
    edges, each shifted by the size of the ranges below. The list of ranges has
    one row per million edges of a hub, and no more than ``MAX_HOT_KEYS`` x
    ``HOT_SLICES``, so it is broadcast.
    """
    hubs = hot_keys(degrees, ["src"], "degree", hot_rows, max_salts=config.HOT_SLICES)
    place = F.floor(F.col("dst") * F.col("_slices") / n_nodes).cast("int")
    marked = links.join(F.broadcast(hubs), "src", "left").withColumn(
        "_slice", F.when(F.col("_slices").isNotNull(), place).otherwise(0)
    )
    sizes = marked.where(F.col("_slices").isNotNull()).groupBy("src", "_slice").agg(
        F.count(F.lit(1)).alias("_size")
    )
    below = Window.partitionBy("src").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("src", "_slice", F.sum("_size").over(below).alias("_shift"))
    inside = Window.partitionBy("src", "_slice").orderBy("dst")
    return marked.join(F.broadcast(shifts), ["src", "_slice"], "left").select(
        "src",
        "dst",
        (F.coalesce("_shift", F.lit(0)) + F.row_number().over(inside) - 1).alias("pos"),
    )


def _info(degree: Column, back: Column) -> Column:
    return F.shiftleft(degree, 1) + back.cast("bigint")


def prepare(
    edges: DataFrame, directed: bool = True, hot_rows: int = config.HOT_ROWS
) -> WalkGraph:
    """Number the nodes and neighbours of a distinct edge list."""
    edges = materialise(edges, "edges")
    nodes = materialise(number_nodes(edges), "nodes")
    n_nodes = nodes.count()

    by_src = skew_join(
        edges, nodes.select(F.col("id").alias("src"), F.col("node").alias("s")), ["src"],
        "inner", hot_rows,
    )
    links = skew_join(
        by_src, nodes.select(F.col("id").alias("dst"), F.col("node").alias("d")), ["dst"],
        "inner", hot_rows,
    ).select(F.col("s").alias("src"), F.col("d").alias("dst"))
    if not directed:
        links = links.union(links.select("dst", "src")).distinct()
    links = materialise(links, "links")

    degrees = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    placed = number_neighbours(links, degrees, n_nodes, hot_rows=hot_rows)
    indegree = links.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    with_degree = salted_join(
        placed,
        degrees.withColumnRenamed("src", "dst"),
        ["dst"],
        hot_keys(indegree, ["dst"], hot_rows=hot_rows),
    )
    if directed:
        reverse = links.select(
            F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_back")
        )
        with_back = with_degree.join(reverse, ["src", "dst"], "left")
        back = F.coalesce("_back", F.lit(False))
    else:
        with_back, back = with_degree, F.lit(True)
    # At least as many buckets as a shuffle has partitions: else Spark would rather
    # shuffle the buckets too.
    buckets = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // config.EDGES_PER_BUCKET))
    neighbours = bucketed(
        with_back.select(
            F.col("src").cast("bigint").alias("src"), F.col("pos").cast("bigint").alias("pos"), "dst",
            F.coalesce("degree", F.lit(0)).alias("degree"), back.alias("back"),
        ),
        "neighbours",
        ["src", "pos"],
        buckets,
    )
    links = bucketed(
        links.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")),
        "links",
        ["src", "dst"],
        buckets,
    )
    places = neighbours.join(degrees.where(F.col("degree") <= config.LISTED).select("src"), "src").groupBy("src").agg(
        F.sort_array(F.collect_list(F.struct("pos", "dst", _info(F.col("degree"), F.col("back")).alias("info")))).alias("all")
    )
    lists = bucketed(
        places.select("src", F.col("all.dst").alias("dst"), F.col("all.info").alias("info")), "lists", ["src"], buckets
    )
    starts = nodes.join(degrees, nodes["node"] == degrees["src"], "left").select(
        "node", F.coalesce("degree", F.lit(0)).alias("degree")
    )
    return WalkGraph(nodes, links, neighbours, starts, n_nodes, lists)


_SPREAD = 1_000_003
_SCALE = 2**52
_STATE = ["walk_id", "step", "prev", "prev_degree", "cur", "degree", "back"]
# Offset of a try within its round, above the number it is packed with.
_OFFSET_BITS = 56


def _packed(offset: Column, number: Column) -> Column:
    return F.shiftleft(offset.cast("bigint"), _OFFSET_BITS).bitwiseOR(number.cast("bigint"))


def _unpacked(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))


def _number_type(num_walks: int) -> str:
    return "tinyint" if num_walks <= 128 + 127 else "int"


def _lowest(num_walks: int) -> int:
    return -128 if num_walks <= 128 + 127 else 0


def _numbers(num_walks: int) -> Column:
    """A node's walks, numbered from the lowest number of the smallest type that has room."""
    low = _lowest(num_walks)
    numbers = F.sequence(F.lit(low), F.lit(low + num_walks - 1))
    return numbers.cast(f"array<{_number_type(num_walks)}>")


def _base(node: Column, num_walks: int) -> Column:
    """What a walk's number within its node is added to for the number of the walk."""
    return node * num_walks - _lowest(num_walks)


class _Rounds:
    """One round of tries for all walkers.

    The expressions are the same in every round, so they are built once.
    """

    def __init__(self, walk_graph: WalkGraph, p: float, q: float, seed: int, hot_rows: int):
        self.most = max(1.0, 1.0 / q)
        self.extra = max(0.0, 1.0 / p - self.most)
        self.least = min(1.0 / p, 1.0, 1.0 / q)
        self.weights = {"if_back": 1.0 / p, "if_tied": 1.0, "if_far": 1.0 / q}
        self.kept = (
            F.when(F.col("x") == F.col("prev"), F.col("if_back"))
            .when(F.col("linked"), F.col("if_tied"))
            .otherwise(F.col("if_far"))
        )
        self.key = F.concat_ws("|", F.lit(str(seed)), "walk_id", "step", F.lit(""))
        self.hot_rows = hot_rows
        self.batches = {}
        self.exploded = [
            *[F.col(name) for name in [*_STATE, "tried"]],
            F.size("_digests").alias("made"),
            F.posexplode_outer("_digests").alias("offset", "digest"),
        ]
        self.neighbours = walk_graph.neighbours.select(
            F.col("src").alias("cur"), "pos", F.col("dst").alias("x"),
            F.col("degree").alias("x_degree"), F.col("back").alias("x_back"),
        )
        lists = walk_graph.lists.hint("shuffle_hash")
        self.lists = lists.withColumnRenamed("src", "cur")
        self.beside = lists.select(F.col("src").alias("prev"), F.col("dst").alias("beside"))
        self.q, self.seed = q, seed
        self.drawn = draws.drawn(p, q, seed)
        # Tries that an edge decides are kept with it, or without it if far nodes weigh more.
        self.kept_with_edge = q > 1
        self.links = walk_graph.links.select(
            F.col("src").alias("tie"), F.col("dst").alias("x"), F.lit(True).alias("linked")
        )
        self._draw_columns()
        self._keep_columns()

    def _draw_columns(self):
        degree = F.col("degree")
        u1 = hex_number(F.col("digest"), 1, 13) / float(_SCALE)
        u2 = hex_number(F.col("digest"), 14, 13) / float(_SCALE)
        bound = degree * self.most
        x = u1 * (bound + F.when(F.col("back"), F.lit(self.extra)).otherwise(0.0))
        ret = x >= bound
        level = u2 * self.most
        # A straight return looks nothing up; a spread position keeps its row
        # from piling up with others.
        place = F.when(ret, u2 * degree).otherwise(x / self.most)
        sure = ret | (degree == 1) | (level < self.least)
        nowhere = -1 - F.pmod(F.col("walk_id"), F.lit(_SPREAD))
        self.draw = {
            "pos": F.least(F.floor(place).cast("bigint"), degree - 1),
            "ret": ret,
            # Whether each weight would do: flags shuffle smaller than the level.
            **{name: level < weight for name, weight in self.weights.items()},
            "sure": sure,
            # A try that is certain needs no edge test; it is sent to a key that
            # matches nothing and is shared by few.
            "tie": F.when(sure, nowhere).otherwise(F.col("prev")),
        }
        # The digits of u2 alone tell that a try is certain: hex digits of one
        # length compare as text like the numbers they spell.
        certain = math.ceil(min(1.0, self.least / self.most) * _SCALE)
        self.certain = lambda digest: F.substring(digest, 14, 13) < f"{certain:013x}"
        self.load = F.ceil(F.count(F.lit(1)) * F.lit(self.most / self.least) / F.max("degree"))

    def _keep_columns(self):
        kept = F.col("sure") | self.kept
        node = F.when(F.col("ret"), F.col("prev")).otherwise(F.col("x"))
        degree = F.when(F.col("ret"), F.col("prev_degree")).otherwise(F.col("x_degree"))
        back = F.when(F.col("ret"), True).otherwise(F.col("x_back"))
        info = _info(degree, back)
        # Both minima come from the first kept try: the offset stands on top.
        self.outcome = [
            F.min(F.when(kept, _packed(F.col("offset"), node))).alias("to"),
            F.min(F.when(kept, _packed(F.col("offset"), info))).alias("info"),
            F.max(F.col("tried") + F.col("made")).alias("tried"),
        ]
        self.useful = kept | (F.col("offset") == F.col("made") - 1)
        moved = F.col("to").isNotNull()

        def then(new, old):
            return F.when(moved, new).otherwise(F.col(old))

        self.next_state = [
            F.col("walk_id"),
            then(F.col("step") + 1, "step").alias("step"),
            then(F.col("cur"), "prev").alias("prev"),
            then(F.col("degree"), "prev_degree").alias("prev_degree"),
            then(_unpacked(F.col("to")), "cur").alias("cur"),
            then(F.shiftright(_unpacked(F.col("info")), 1), "degree").alias("degree"),
            then(F.col("info").bitwiseAND(F.lit(1)) == 1, "back").alias("back"),
            then(F.lit(0), "tried").cast("bigint").alias("tried"),
        ]

    def first(self, starts: DataFrame, num_walks: int) -> DataFrame:
        """The first step of every walk, which has no bias: one draw, always kept.

        One row per edge that is taken, with the numbers ``ks`` of the walks of its
        source that take it: they start in one task and are drawn and listed there on
        arrays, so edges are shuffled and not walkers. Every node has the same number of walkers here, so
        nothing can be hot.
        """
        kind = _number_type(num_walks)
        drawn = draws.first_drawn(num_walks, _lowest(num_walks), {"tinyint": "int8", "int": "int32"}[kind], self.q, self.seed)
        taken = starts.select("node", F.col("degree").cast("bigint").alias("degree")).mapInArrow(
            drawn, f"cur bigint, degree bigint, pos bigint, ks array<{kind}>"
        )
        return taken.join(self.neighbours, ["cur", "pos"]).select(
            "ks",
            F.col("cur").alias("prev"),
            F.col("degree").alias("prev_degree"),
            F.col("x").alias("cur"),
            F.col("x_degree").alias("degree"),
            F.col("x_back").alias("back"),
        )

    def _try_columns(self, tries: int):
        many = F.when(F.col("degree") == 1, 1).otherwise(tries)
        numbers = F.sequence(F.col("tried"), F.col("tried") + many - 1)
        digests = F.transform(numbers, lambda n: F.md5(F.concat("_key", n).cast("binary")))
        stop = F.array_position(F.transform("_digests", self.certain), True)
        length = F.when(stop > 0, stop.cast("int")).otherwise(F.size("_digests"))
        return digests, F.slice("_digests", F.lit(1), length)

    def _tries(self, frontier: DataFrame, tries: int) -> DataFrame:
        """One row per try, up to the first that is certain to be kept."""
        if tries not in self.batches:
            self.batches[tries] = self._try_columns(tries)
        digests, cut = self.batches[tries]
        return (
            frontier.withColumn("_key", self.key)
            .withColumn("_digests", digests)
            .withColumn("_digests", cut)
            .select(*self.exploded)
            .withColumns(self.draw)
        )

    def _look_up(self, draws: DataFrame, frontier: DataFrame, n_walkers: int) -> DataFrame:
        """The drawn neighbour of each try.

        Positions spread the walkers at a hub, but many walkers may stand at a
        node with few out-edges. Such nodes are found by counting the frontier; their
        edges are broadcast, at most one per ``hot_rows`` tries, and their tries go
        on to keys that match nothing and are shared by few. With fewer walkers than
        ``hot_rows`` no node can be hot, and the count is not made.
        """
        if n_walkers < self.hot_rows:
            return draws.join(self.neighbours, ["cur", "pos"])
        load = frontier.groupBy("cur").agg(self.load.alias("n"))
        hot = F.broadcast(hot_keys(load, ["cur"], hot_rows=self.hot_rows)).drop("_slices")
        found = self.neighbours.join(hot, "cur").select(
            "cur", "pos", F.struct("x", "x_degree", "x_back").alias("_hot")
        )
        names = ["x", "x_degree", "x_back"]
        rest = self.neighbours.select(
            F.col("cur").alias("_key"), F.col("pos").alias("_place"), F.struct(*names).alias("_cold")
        )
        nowhere = -1 - F.pmod(F.col("walk_id"), F.lit(_SPREAD))
        marked = draws.join(F.broadcast(found), ["cur", "pos"], "left")
        key = F.when(F.col("_hot").isNull(), F.col("cur")).otherwise(nowhere)
        joined = marked.withColumns({"_key": key, "_place": F.col("pos")}).join(rest, ["_key", "_place"], "left")
        edge = F.coalesce("_hot", "_cold")
        return joined.select(*draws.columns, *(edge[name].alias(name) for name in names))

    def beside_lists(self, frontier: DataFrame) -> DataFrame:
        """The walkers after a move, of those whose node and last node have lists."""
        drawn = frontier.join(self.lists, "cur").mapInArrow(self.drawn, draws.SCHEMA)
        linked = F.transform("asked", lambda x: F.array_contains("beside", x))
        hit = F.array_position(linked, self.kept_with_edge).cast("int")
        found = drawn.join(self.beside, "prev").withColumn("_hit", hit)
        for name, asked in (("to", "asked"), ("info", "asked_info")):
            found = found.withColumn(name, F.when(F.col("_hit") > 0, F.get(asked, F.col("_hit") - 1)).otherwise(F.col(name)))
        return found.select(
            "walk_id", (F.col("step") + 1).alias("step"), F.col("cur").alias("prev"), F.col("degree").alias("prev_degree"),
            F.col("to").alias("cur"), F.shiftright("info", 1).alias("degree"),
            (F.col("info").bitwiseAND(F.lit(1)) == 1).alias("back"), F.lit(0).cast("bigint").alias("tried"),
        )

    def crowded(self, frontier: DataFrame) -> list[int]:
        """Nodes that ``hot_rows`` walkers or more stand at or came from; few by construction."""
        spots = frontier.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(name).alias("node")) for k, name in enumerate(("cur", "prev"))))).alias("at"))
        found = spots.groupBy("at").count().where(F.col("count") >= self.hot_rows)
        return sorted({row[0] for row in found.select("at.node").collect()})

    def moved(self, frontier: DataFrame, n_listed: int, n_others: int, tries: int) -> DataFrame:
        """The walkers after a round of which ``n_listed`` may move beside lists, unless crowded."""
        beside, crowded = _listed(), []
        if n_listed >= self.hot_rows:
            crowded = self.crowded(frontier.where(beside))
        if crowded:
            nodes = frontier.sparkSession.createDataFrame([(node,) for node in crowded], "_node bigint")
            for name in ("cur", "prev"):
                hot = F.broadcast(nodes.select(F.col("_node").alias(name), F.lit(True).alias(f"_{name}")))
                frontier = frontier.join(hot, name, "left")
            beside = beside & F.col("_cur").isNull() & F.col("_prev").isNull()
        names = [*_STATE, "tried"]
        parts = []
        if n_listed:
            parts.append(self.beside_lists(frontier.where(beside).select(*names)))
        if n_others or crowded:
            parts.append(self.after(frontier.where(~beside).select(*names), n_listed + n_others, tries))
        return reduce(DataFrame.unionByName, parts)

    def after(self, frontier: DataFrame, n_walkers: int, tries: int) -> DataFrame:
        """The walkers after a round: moved on, or with more tries behind them."""
        drawn = self._look_up(self._tries(frontier, tries), frontier, n_walkers)
        return (
            drawn.join(self.links, ["tie", "x"], "left")
            .where(self.useful)
            .groupBy(*_STATE)
            .agg(*self.outcome)
            .select(*self.next_state)
        )


def _listed() -> Column:
    """Whether a walker's node and its last node have lists."""
    return (F.col("degree") <= config.LISTED) & (F.col("prev_degree") <= config.LISTED)


def _counts(can_move: Column, walkers: Column) -> list[Column]:
    return [F.sum(F.when(can_move & which, walkers)).alias(name) for name, which in (("listed", _listed()), ("others", ~_listed()))]


def _counted(seen: Observation) -> tuple[int, int]:
    return seen.get["listed"] or 0, seen.get["others"] or 0


def moves(
    walk_graph: WalkGraph,
    num_walks: int = config.NUM_WALKS,
    walk_length: int = config.WALK_LENGTH,
    p: float = config.RETURN_P,
    q: float = config.IN_OUT_Q,
    seed: int = 0,
    tries: int = config.TRIES_PER_ROUND,
    hot_rows: int = config.HOT_ROWS,
) -> DataFrame:
    """All visits of all walks: ``base, ks, step, node, prev, last`` with node numbers.

    ``last`` tells of the first two steps whether the walks end there, for :func:`walk_paths`.
    Walks that make the same first step are one row, and so are those that start at a
    node; later steps have a row each. Their numbers are ``base`` plus each of ``ks``
    (see :func:`spread`), which takes a byte a walk where rows are shuffled. Names are best joined here, before the rows are
    spread to one per visit. ``num_walks`` walks start at every node and have up to ``walk_length``
    nodes; a walk that reaches a node without out-edges ends there. The walk
    number is ``node * num_walks + k``.
    """
    spark = walk_graph.starts.sparkSession
    folder = scratch_path(spark, "walks")
    # Sized by the walkers to come: a small node table would otherwise put all
    # of them into a few tasks, here and in the rounds that read its files.
    tasks = max(
        spark.sparkContext.defaultParallelism,
        -(-walk_graph.n_nodes * num_walks // config.WALKERS_PER_TASK),
    )
    starts = walk_graph.starts.repartition(tasks, "node")
    # Where walks start follows from the nodes, so it is not written.
    seen_at = [
        walk_graph.starts.select(
            _base(F.col("node"), num_walks).alias("base"), _numbers(num_walks).alias("ks"),
            F.lit(0).cast("bigint").alias("step"), "node", F.col("node").alias("prev"),
            ((F.col("degree") == 0) | F.lit(walk_length < 2)).alias("last"),
        )
    ]
    if walk_length < 2:
        return seen_at[0]
    rounds = _Rounds(walk_graph, p, q, seed, hot_rows)
    current = rounds.first(starts.where("degree > 0"), num_walks)
    schema = current.schema
    can_move = (F.col("degree") > 0) & (F.lit(walk_length) > 2)
    path = f"{folder}/first"
    seen = Observation()
    with freed_shuffles(spark):
        current.observe(seen, *_counts(can_move, F.size("ks"))).write.parquet(path)
    n_listed, n_others = _counted(seen)
    first = spark.read.schema(schema).parquet(path).withColumns(
        {"base": _base(F.col("prev"), num_walks), "step": F.lit(1).cast("bigint")}
    )
    names = ["base", "ks", "step", F.col("cur").alias("node"), "prev"]
    seen_at.append(first.select(*names, (~can_move).alias("last")))
    live = spread(first.where(can_move)).select(*_STATE, F.lit(0).cast("bigint").alias("tried"))
    can_move = (F.col("degree") > 0) & (F.col("step") < walk_length - 1)
    paths = []
    while n_listed or n_others:
        # Few walkers: fewer rounds count. Many: so does the work per round.
        batch = tries if n_listed + n_others >= hot_rows else 2 * tries
        current = rounds.moved(live, n_listed, n_others, batch)
        schema = current.schema
        paths.append(f"{folder}/round={len(paths)}")
        seen = Observation()
        with freed_shuffles(spark):
            current.observe(seen, *_counts(can_move, F.lit(1))).write.parquet(paths[-1])
        n_listed, n_others = _counted(seen)
        live = spark.read.schema(schema).parquet(paths[-1]).where(can_move)
    if paths:
        # A walker is written once on arrival (no tries yet) and once per round it waits.
        arrived = spark.read.schema(schema).parquet(*paths).where("tried = 0")
        alone = {"base": F.col("walk_id"), "ks": F.array(F.lit(0).cast(_number_type(num_walks)))}
        seen_at.append(arrived.withColumns(alone).select(*names, F.lit(None).cast("boolean").alias("last")))
    return reduce(DataFrame.unionByName, seen_at)


def visits(walk_graph: WalkGraph, *settings, **named_settings) -> DataFrame:
    """:func:`moves` with a row per visit: ``walk_id, step, node, prev, last``."""
    return spread(moves(walk_graph, *settings, **named_settings))


def spread(moved: DataFrame) -> DataFrame:
    """One row per walk of each row of :func:`moves`, other columns kept."""
    others = [name for name in moved.columns if name not in ("base", "ks")]
    each = moved.select("base", F.explode("ks").alias("k"), *others)
    return each.select((F.col("base") + F.col("k")).alias("walk_id"), *others)


def walk_paths(visited: DataFrame) -> DataFrame:
    """One row per walk with its nodes in order; a walk has a bounded length.

    Visits from :func:`visits` or :func:`moves` tell of a walk's start and first step whether
    it ends there. Such walks are one row, which has the node before it too, and only the
    visits of longer walks are shuffled.
    """
    moved = "ks" in visited.columns

    def each(rows: DataFrame) -> DataFrame:
        return spread(rows) if moved else rows

    if "last" not in visited.columns:
        return _gathered(each(visited), F.array("node"))
    start, first, last = F.col("step") == 0, F.col("step") == 1, F.coalesce("last", F.lit(False))
    path = F.when(start, F.array("node")).otherwise(F.array("prev", "node"))
    ended = each(visited.where((start | first) & last)).select("walk_id", path.alias("path"))
    # The first step names the start, so the start of a walk that goes on is left out.
    longer = each(visited.where(~(start | (first & last))))
    return ended.unionByName(_gathered(longer, F.when(first, path).otherwise(F.array("node"))))


def _gathered(visited: DataFrame, nodes: Column) -> DataFrame:
    """``walk_id, path``: the nodes of each visit in the order of the steps."""
    steps = F.sort_array(F.collect_list(F.struct("step", nodes.alias("nodes"))))
    return visited.groupBy("walk_id").agg(F.flatten(F.transform(steps, lambda visit: visit["nodes"])).alias("path"))


def named_paths(visited: DataFrame, nodes: DataFrame) -> DataFrame:
    """:func:`walk_paths` with node ids instead of node numbers, of visits or moves."""
    walks = [name for name in ("walk_id", "base", "ks", "step", "last") if name in visited.columns]
    if "last" not in walks:
        return walk_paths(skew_join(visited, nodes, ["node"], "inner").select(*walks, F.col("id").alias("node")))
    # The rows of starts that go on name no walk's path; of the others the first steps need both names.
    needed = visited.where((F.col("step") > 0) | F.col("last"))
    named = skew_join(needed, nodes, ["node"], "inner").select(*walks, "prev", F.col("id").alias("name"))
    before = nodes.select(F.col("node").alias("prev"), F.col("id").alias("before"))
    first = skew_join(named.where("step = 1"), before, ["prev"], "inner").select(*walks, F.col("before").alias("prev"), F.col("name").alias("node"))
    rest = named.where("step <> 1").select(*walks, F.lit(None).cast("string").alias("prev"), F.col("name").alias("node"))
    return walk_paths(first.unionByName(rest))
