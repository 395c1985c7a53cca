import random
from dataclasses import replace

import numpy as np
import pytest
from brute import body, byte_repeats, sha, word_repeats
from hypothesis import given, settings
from hypothesis import strategies as st

from tastegraph.llm import passages, substring_dedup, suffix_dedup


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_order_is_sorted(units):
    expected = sorted(range(len(units)), key=lambda i: units[i:])
    assert suffix_dedup.suffix_order(np.array(units, np.int64)).tolist() == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=4), st.lists(st.integers(0, 2), max_size=12))
def test_matching_statistics(texts, query):
    automaton = substring_dedup.SuffixAutomaton()
    for t in texts:
        automaton.add(t)
    known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    expected = [
        max((n for n in range(1, i + 2) if tuple(query[i + 1 - n : i + 1]) in known), default=0)
        for i in range(len(query))
    ]
    assert automaton.statistics(query).tolist() == expected


def test_equal_windows_have_the_same_gram_at_the_same_distance():
    rnd = np.random.default_rng(3)
    one, two = rnd.integers(0, 9, 500).astype(np.uint64), rnd.integers(0, 9, 400).astype(np.uint64)
    two[100:200] = one[300:400]
    a, b = (passages.stretches(passages.mix64(x), 30, 10) for x in (one, two))

    def gram_at(found, window):
        k = np.searchsorted(found[2], window, side="right") - 1
        return found[0][k]

    assert all(gram_at(a, 300 + i) == gram_at(b, 100 + i) for i in range(71))


def _with(plan, crowd):
    return lambda *a: replace(plan(*a), crowd=crowd, chunk=2000)


@pytest.mark.parametrize("crowd", [64, 1])
def test_suffix_dedup_against_brute_force(docs_of, odd_pairs, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "plan", _with(suffix_dedup.plan, crowd))
    expected = byte_repeats(odd_pairs, 60)
    found = suffix_dedup.remove_repeats(docs_of(odd_pairs), 60, 30).collect()
    assert len(found) == len(odd_pairs)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in found)
    assert got == sorted((str(i), *expected[i, body(t)]) for i, t in odd_pairs)
    assert any(r.n_removed for r in found)


@pytest.mark.parametrize("crowd", [64, 1])
def test_substring_dedup_against_brute_force(docs_of, odd_pairs, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "plan", _with(substring_dedup.plan, crowd))
    pairs = [p for p in odd_pairs if p[0] is not None] + [(None, "no id at all")]
    expected = word_repeats(pairs, 8)
    found = substring_dedup.remove_repeats(docs_of(pairs), 8, 4).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, sha(bytes(r.kept))) for r in found)
    assert got == sorted((str(i), *expected[i, body(t)]) for i, t in pairs)
    assert any(r.n_removed for r in found)


def test_empty_tables(docs_of):
    empty = docs_of([])
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    alone = docs_of([(1, None), (2, "")])
    assert {(r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(alone).collect()} == {(0, 0)}


def test_a_passage_in_very_many_documents(docs_of):
    rnd = random.Random(1)
    passage = " ".join(f"p{k}" for k in range(40))
    pairs = [(i, " ".join([f"a{rnd.random()}" for _ in range(15)] + [passage] + [f"b{rnd.random()}" for _ in range(15)])) for i in range(200)]
    found = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs_of(pairs)).collect()}
    assert found == {i: 40 if i else 0 for i in range(200)}
    spans = {r.doc_id: (r.n_spans, r.n_removed) for r in suffix_dedup.remove_repeats(docs_of(pairs), 100, 50).collect()}
    assert {n for n, _ in spans.values()} == {1}
    assert min(n for _, n in spans.values()) >= len(passage)
