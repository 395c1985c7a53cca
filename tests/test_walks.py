import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegraph import config
from tastegraph.operators import draws, vectors, walks
from tastegraph.plans.catalog import _edges
from tastegraph.session import materialise


def numbered_paths(graph, **settings):
    visited = walks.visits(graph, **settings)
    return {r["walk_id"]: r["path"] for r in walks.walk_paths(visited).collect()}


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")


def test_dead_ends_keep_short_walks(spark, chain):
    prepared = walks.prepare(chain)
    visited = walks.visits(prepared, num_walks=1, walk_length=25)
    found = sorted(r["path"] for r in walks.named_paths(visited, prepared.nodes).collect())
    assert found == [["a", "b", "c"], ["b", "c"], ["c"]]


@pytest.fixture(scope="module")
def random_edges(spark):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(400)}
    hub = {(f"n{i}", "hub") for i in range(60)} | {("hub", f"n{i}") for i in range(60)}
    return spark.createDataFrame(sorted(pairs | hub), "src string, dst string")


@pytest.mark.parametrize("directed", [True, False])
def test_walks_follow_edges(random_edges, directed):
    prepared = walks.prepare(random_edges, directed)
    links = {tuple(r) for r in prepared.links.collect()}
    paths = numbered_paths(prepared, num_walks=2, walk_length=8)
    assert len(paths) == 2 * prepared.nodes.count()
    sources = {src for src, _ in links}
    for walk_id, path in paths.items():
        assert path[0] == walk_id // 2
        assert all(step in links for step in zip(path, path[1:]))
        assert len(path) == 8 or path[-1] not in sources


def test_walks_do_not_depend_on_layout(spark, random_edges):
    plain = numbered_paths(walks.prepare(random_edges), num_walks=2, walk_length=6, tries=16)
    # Other batch of tries, other partitioning, hub numbered in ranges, keys salted.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        prepared = walks.prepare(random_edges.repartition(9), hot_rows=10)
        other = numbered_paths(prepared, num_walks=2, walk_length=6, tries=1, hot_rows=5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plain == other


def test_seed_changes_walks(random_edges):
    prepared = walks.prepare(random_edges)
    first = numbered_paths(prepared, num_walks=1, walk_length=6)
    assert first == numbered_paths(prepared, num_walks=1, walk_length=6)
    assert first != numbered_paths(prepared, num_walks=1, walk_length=6, seed=1)


@pytest.mark.parametrize("p,q", [(0.25, 4.0), (4.0, 0.5)])
def test_second_step_has_the_right_distribution(spark, p, q):
    """From t to v, the next node has weight 1/p (t), 1 (tied to t) or 1/q."""
    edges = spark.createDataFrame(
        [("t", "v"), ("v", "t"), ("v", "near"), ("v", "far"), ("v", "far2"), ("t", "near")],
        "src string, dst string",
    )
    prepared = walks.prepare(edges)
    names = {r["node"]: r["id"] for r in prepared.nodes.collect()}
    paths = numbered_paths(prepared, num_walks=6000, walk_length=3, p=p, q=q)
    seen = [
        names[path[2]] for path in paths.values()
        if len(path) == 3 and [names[n] for n in path[:2]] == ["t", "v"]
    ]
    weights = {"t": 1 / p, "near": 1.0, "far": 1 / q, "far2": 1 / q}
    total = sum(weights.values())
    assert len(seen) > 2000
    for node, weight in weights.items():
        assert seen.count(node) / len(seen) == pytest.approx(weight / total, abs=0.03)


def test_neighbour_positions_are_dense(random_edges):
    for hot_rows in (10, 1_000_000):
        prepared = walks.prepare(random_edges, hot_rows=hot_rows)
        rows = prepared.neighbours.groupBy("src").agg(
            F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("all")
        ).collect()
        for row in rows:
            assert [x["pos"] for x in row["all"]] == list(range(len(row["all"])))
            assert [x["dst"] for x in row["all"]] == sorted(x["dst"] for x in row["all"])


def test_cooccurrences_equal_brute_force(spark):
    paths = [[1, 2, 3, 2, 5, 6, 7], [4], [3, 3, 1]]
    df = spark.createDataFrame([(p,) for p in paths], "path array<bigint>")
    for window in (2, 15):
        expected = {}
        for path in paths:
            for i, center in enumerate(path):
                for j, context in enumerate(path):
                    if i != j and abs(i - j) <= window:
                        expected[center, context] = expected.get((center, context), 0) + 1
        found = {tuple(r)[:2]: r["n"] for r in vectors.cooccurrences(df, window).collect()}
        assert found == expected


@pytest.fixture(scope="module")
def trained_on(fx):
    prepared = walks.prepare(_edges(fx))
    paths = walks.walk_paths(walks.visits(prepared, num_walks=2, walk_length=6))
    from tastegraph.session import materialise

    return materialise(paths, "test-paths"), prepared.nodes


@pytest.mark.parametrize("method", list(vectors.METHODS))
def test_every_node_gets_a_vector(trained_on, method):
    paths, nodes = trained_on
    found = vectors.node_vectors(paths, nodes, 8, 5, method=method).collect()
    assert len(found) == nodes.count() == len({r["id"] for r in found})
    assert {len(r["embedding"]) for r in found} == {8}


def test_vectors_do_not_depend_on_the_sizes_that_only_affect_speed(trained_on, monkeypatch):
    paths, nodes = trained_on

    def found():
        rows = vectors.node_vectors(paths, nodes, 4, 3).collect()
        return {r["id"]: [round(x, 4) for x in r["embedding"]] for r in rows}

    usual = found()
    for name in ("HOT_ROWS", "WALKERS_PER_TASK", "MAX_SALTS"):
        monkeypatch.setattr(config, name, 50)
    assert found() == usual


def test_rounds_shuffle_no_edge(spark, random_edges):
    """Each bucketed edge table is joined as it lies, with hot nodes and without."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prepared = walks.prepare(random_edges)
        frontier = prepared.starts.where("degree > 0").selectExpr(
            "node as walk_id", "1L as step", "node as prev", "degree as prev_degree", "node as cur", "degree",
            "true as back", "0L as tried",
        )
        for hot_rows, walkers in ((10**6, 5), (3, 10**7)):
            rounds = walks._Rounds(prepared, 0.25, 4.0, 0, hot_rows)
            plan = rounds.after(frontier, walkers, 4)._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            scans = [k for k, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line]
            assert len(scans) >= 2
            for k in scans:
                # The first exchange or join above a scan, by depth of the tree.
                depth = lines[k].index("FileScan")
                above = None
                for line in reversed(lines[:k]):
                    at = len(line) - len(line.lstrip(" :|+-*("))
                    if at < depth:
                        depth = at
                        if "Exchange" in line or "Join" in line:
                            above = line
                            break
                assert "Join" in above or "BroadcastExchange" in above, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_skip_gram_is_repeatable(trained_on):
    paths, nodes = trained_on
    first, second = (
        sorted(map(str, vectors.skip_gram_vectors(paths, nodes, 4, 3, seed=5).collect()))
        for _ in range(2)
    )
    assert first == second


@pytest.mark.parametrize(
    "settings",
    [{"method": "factorise"}, {"method": "skip_gram", "iterations": 12}, {"method": "skip_gram", "iterations": 12, "blocks": 3}],
)
def test_vectors_separate_groups(spark, settings):
    """Nodes of a group that walks stay in are closer to each other than to the rest."""
    edges = [(f"n{a}", f"n{b}") for g in range(3) for a in range(8 * g, 8 * g + 8) for b in range(a + 1, 8 * g + 8)]
    edges += [("n0", "n8"), ("n8", "n16"), ("n16", "n0")]
    prepared = walks.prepare(spark.createDataFrame(edges, "src string, dst string"), directed=False)
    paths = walks.walk_paths(walks.visits(prepared, num_walks=10, walk_length=10))
    rows = vectors.node_vectors(paths, prepared.nodes, 8, 4, **settings).collect()
    found = {int(r["id"][1:]): r["embedding"] for r in rows}

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return dot / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    pairs = [(a, b) for a in found for b in found if a < b]
    inside = [cosine(found[a], found[b]) for a, b in pairs if a // 8 == b // 8]
    across = [cosine(found[a], found[b]) for a, b in pairs if a // 8 != b // 8]
    assert sum(inside) / len(inside) > sum(across) / len(across) + 0.3


def test_the_first_step_shuffles_edges_and_not_walkers(spark, random_edges):
    """Walks that take the same first edge are one row, here and in what is written."""
    prepared = walks.prepare(random_edges)
    moved = walks.moves(prepared, num_walks=200, walk_length=2)
    rows = moved.where("step = 1").select("prev", "node", F.size("ks").alias("n")).collect()
    links = prepared.links.count()
    assert len(rows) == len({(r["prev"], r["node"]) for r in rows}) <= links
    sources = prepared.links.select("src").distinct().count()
    assert sum(r["n"] for r in rows) == 200 * sources > 5 * links


@pytest.mark.parametrize("num_walks", [1, 128, 255, 256, 300])
def test_walks_are_numbered_whatever_the_type_of_their_numbers(chain, num_walks):
    prepared = walks.prepare(chain)
    visited = walks.visits(prepared, num_walks, 3).collect()
    starts = sorted(r["walk_id"] for r in visited if r["step"] == 0)
    assert starts == list(range(3 * num_walks))
    assert all(r["node"] == r["walk_id"] // num_walks for r in visited if r["step"] == 0)
    assert len(visited) == (3 + 2 + 1) * num_walks


@pytest.mark.parametrize("walk_length,expected", [(1, {1}), (2, {1, 2}), (3, {1, 2, 3})])
def test_walks_of_any_length_end(chain, walk_length, expected):
    paths = numbered_paths(walks.prepare(chain), num_walks=2, walk_length=walk_length)
    assert len(paths) == 6 and {len(p) for p in paths.values()} == expected


def test_tries_shuffle_flags_and_no_level(random_edges):
    prepared = walks.prepare(random_edges)
    frontier = prepared.starts.where("degree > 0").selectExpr(
        "node as walk_id", "1L as step", "node as prev", "degree as prev_degree", "node as cur", "degree",
        "true as back", "0L as tried",
    )
    drawn = walks._Rounds(prepared, 0.25, 4.0, 0, 10**6)._tries(frontier, 4)
    assert "double" not in dict(drawn.dtypes).values()


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("p,q", [(0.25, 4.0), (4.0, 0.5), (0.5, 0.25)])
def test_lists_of_neighbours_do_not_change_walks(random_edges, monkeypatch, directed, p, q):
    """Walkers move beside lists, by rows of tries, or each where it can or nodes are crowded."""
    found = []
    for listed, hot_rows in ((64, 10**6), (0, 10**6), (9, 10**6), (64, 12)):
        monkeypatch.setattr(config, "LISTED", listed)
        prepared = walks.prepare(random_edges, directed)
        found.append(numbered_paths(prepared, num_walks=2, walk_length=5, p=p, q=q, hot_rows=hot_rows))
    assert all(other == found[0] for other in found[1:])


def test_walkers_beside_lists_shuffle_a_row_each(spark, random_edges):
    """Their node's list and that of their last node lie in buckets; tries are no rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prepared = walks.prepare(random_edges)
        frontier = materialise(prepared.starts.where("degree > 0").selectExpr(
            "node as walk_id", "1L as step", "node as prev", "degree as prev_degree", "node as cur", "degree",
            "true as back", "0L as tried",
        ), "test-frontier")
        rounds = walks._Rounds(prepared, 0.25, 4.0, 0, 10**6)
        plan = rounds.beside_lists(frontier)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") >= 2, plan
        assert "Explode" not in plan and "posexplode" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbers_of_tries_are_those_of_the_md5_of_their_text():
    rnd = np.random.default_rng(0)
    walk = np.concatenate([rnd.integers(0, 10**digits, 40) for digits in range(1, 19)] + [np.array([0, 9, 10, 99, 100, 2**62])])
    rnd.shuffle(walk)
    step, tried = rnd.integers(0, 200, (2, len(walk)))
    for seed in (0, 41, 10**30):
        first, second = draws.numbers(seed, walk, step, tried)
        for k in range(len(walk)):
            digest = md5(f"{seed}|{walk[k]}|{step[k]}|{tried[k]}".encode()).hexdigest()
            assert (first[k], second[k]) == (int(digest[:13], 16) / 2**52, int(digest[13:26], 16) / 2**52)


@pytest.mark.parametrize("num_walks,walk_length", [(3, 1), (3, 2), (130, 6)])
def test_walks_that_end_early_are_not_gathered(spark, random_edges, num_walks, walk_length):
    """Only visits of walks that go on after their first step are grouped; paths stay the same."""
    ends = spark.createDataFrame([(f"n{i}", f"end{i % 7}") for i in range(60)], "src string, dst string")
    prepared = walks.prepare(random_edges.where("src not in ('n1', 'n2', 'hub')").union(ends))
    visited = materialise(walks.visits(prepared, num_walks, walk_length, seed=3), "test-visits")
    found = sorted((r["walk_id"], r["path"]) for r in walks.walk_paths(visited).collect())
    plain = sorted((r["walk_id"], r["path"]) for r in walks.walk_paths(visited.drop("last", "prev")).collect())
    assert found == plain and len(found) == num_walks * prepared.n_nodes
    names = {r["node"]: r["id"] for r in prepared.nodes.collect()}
    moved = walks.moves(prepared, num_walks, walk_length, seed=3)
    named = sorted((r["walk_id"], r["path"]) for r in walks.named_paths(moved, prepared.nodes).collect())
    assert named == [(walk, [names[node] for node in path]) for walk, path in plain]
    alone = sum(len(path) <= 2 for _, path in plain)
    gathered = []
    real = walks._gathered
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(walks, "_gathered", lambda rows, nodes: gathered.append(rows.count()) or real(rows, nodes))
        walks.walk_paths(visited)
    assert alone and gathered == [sum(len(path) - 1 for _, path in plain if len(path) > 2)]


def test_first_steps_are_drawn_on_arrays(random_edges):
    """No row per walker is formed where the first step is drawn."""
    prepared = walks.prepare(random_edges)
    rounds = walks._Rounds(prepared, 0.25, 4.0, 0, 10**6)
    plan = rounds.first(prepared.starts.where("degree > 0"), 200)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan and "collect_list" not in plan
