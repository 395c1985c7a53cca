import random

import numpy as np
import pytest
from brute import components, simhash

from tastegraph.llm import simhash_dedup as sd
from tastegraph.llm.components import connected_components


def test_components_against_brute_force(docs_of, odd_pairs):
    expected = {t: simhash(t) for _, t in odd_pairs}
    found = sd.simhash_components(docs_of(odd_pairs)).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in found) == sorted(
        (str(i), f"{expected[t]:016x}") for i, t in odd_pairs
    )
    prints = sorted(set(expected.values()))
    roots = components(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in odd_pairs:
        if i is not None:
            root = roots[expected[t]]
            least[root] = min(i, least.get(root, i))
    assert all(r.component_id == least.get(roots[int(r.fingerprint, 16)]) for r in found)


@pytest.mark.parametrize("size", [2048, 3])
def test_links_span_all_close_fingerprints(spark, size):
    rnd = random.Random(2)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    prints = set(seeds)
    for s in seeds[:6]:
        for _ in range(25):
            prints.add(s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    links = sd.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), tree_size=size)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert {p: roots.get(p, p) for p in signed} == components(signed, close)


def test_bk_tree_finds_what_a_scan_finds():
    rnd = random.Random(3)
    values = [rnd.getrandbits(10) for _ in range(300)]
    tree = sd.BkTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 37):
        assert {tree.values[n] for n in tree.near(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}


def test_keep_first(docs_of, odd_pairs):
    docs = docs_of(odd_pairs)
    kept = sd.keep_first(docs)
    assert kept.columns == docs.columns
    groups = {(r.doc_id, r.component_id) for r in sd.simhash_components(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        i for i, c in groups if i is not None and i == c
    )


def test_empty_table(docs_of):
    assert sd.simhash_components(docs_of([])).count() == 0
    assert sd.keep_first(docs_of([])).count() == 0


def test_connected_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 200)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e}
    assert {200: 200, **roots} == components(nodes, edges)
