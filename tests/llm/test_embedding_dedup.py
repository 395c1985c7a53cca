import math
from datetime import date

import numpy as np
import pytest
from brute import components

from tastegraph.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, node long, block int"


def brute(rows, cosine=0.93):
    def usable(v, label):
        return label is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)

    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i is not None and usable(v, lab)]
    links = []
    for x in range(len(good)):
        for y in range(x):
            (i, u, a), (j, v, b) = good[x], good[y]
            if a == b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= cosine and i != j:
                links.append((i, j))
    roots = components({i for i, _, _ in rows if i is not None}, links)
    count = {i: len({j for a, j in links if a == i} | {a for a, j in links if j == i}) for i in roots}
    return sorted((i, count[i], roots[i], roots[i] == i) for i, _, _ in rows if i is not None)


@pytest.mark.parametrize("block", [2048, 16])
def test_links_against_brute_force(spark, block):
    rnd = np.random.default_rng(1)
    rows, centers = [], rnd.normal(size=(6, 8))
    for k in range(150):
        v = centers[k % 6] + rnd.normal(size=8) * rnd.choice([0.05, 0.3, 1.0])
        rows.append((k, v.tolist(), int(k % 6 > 2)))
    rows += [(200 + k, rows[3][1], rows[3][2]) for k in range(20)]
    rows += [(300, (2 * np.array(rows[3][1])).tolist(), rows[3][2]), (301, rows[3][1], None), (302, None, 1)]
    rows += [(303, [0.0] * 8, 1), (304, [float("nan")] * 8, 1), (305, [None, 1.0], 1), (306, [float("inf"), 1.0], 1)]
    rows += [(307, [1.0, 0.0], 1), (308, [1.0, 0.01], 1), (309, [], 1)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    found = sorted(tuple(r) for r in ed.embedding_components(table, block=block).collect())
    assert found == brute(rows)


def test_cosine_is_taken_in_double_precision(spark):
    """Pairs on either side of the threshold, nearer to it than single precision tells apart."""
    rows = []
    for k, over in enumerate((1e-9, -1e-9, 3e-9, -3e-9)):
        c = 0.93 + over
        rows += [(2 * k, [1.0, 0.0], f"pair {k}"), (2 * k + 1, [c, math.sqrt(1 - c * c)], f"pair {k}")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = {r.vec_id: r.n_links for r in ed.embedding_components(table).collect()}
    assert found == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1, 5: 1, 6: 0, 7: 0}


@pytest.mark.parametrize(
    "kind, labels",
    [("string", ["a", "a", "b", None]), ("double", [0.0, -0.0, 1.5, None]), ("binary", [b"\xff", b"\xff", b"\xfe", None]),
     ("date", [date(2024, 1, 1), date(2024, 1, 1), date(2024, 1, 2), None]), ("boolean", [True, True, False, None])],
)
def test_labels_of_any_type_and_clashing_columns(spark, kind, labels):
    schema = f"vec_id int, embedding array<double>, label {kind}, cell int, slice int, dim int, copies int, links int, root int"
    table = spark.createDataFrame([(k, [1.0, 0.5], x, 1, 2, 3, 4, 5, 6) for k, x in enumerate(labels)], schema)
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.embedding_components(table).collect())
    assert found == [(0, 1, 0), (1, 1, 0), (2, 0, 2), (3, 0, 3)]


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    found = sorted((tuple(r) for r in ed.embedding_components(table).collect()), key=str)
    assert found == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, None)]
    assert ed.embedding_components(table.limit(0)).count() == 0


def test_cover_tree_holds_every_point_within_its_radii():
    rnd = np.random.default_rng(2)
    points = ed.unit(np.concatenate((rnd.normal(size=(80, 5)), np.repeat(rnd.normal(size=(1, 5)), 4, axis=0))))
    tree = ed.CoverTree.from_bytes(ed.cover_tree(points).to_bytes())

    def below(node):
        children = tree.below(node).tolist()
        own = [int(tree.center[node])] if children == [node] else [p for c in children for p in below(c)]
        far = np.linalg.norm(points[own] - points[tree.center[node]], axis=1).max()
        assert far <= tree.radius[node] + 1e-7
        return own

    assert sorted(below(0)) == list(range(len(points)))
