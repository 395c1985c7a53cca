import itertools
import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tastegraph.llm import line_dedup, packing


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_patience_aligns_equal_lines_in_order(a, b):
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))


def test_patience_of_equal_texts_and_moved_blocks():
    assert line_dedup.patience([1, 2, 2, 3], [1, 2, 2, 3]) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert line_dedup.patience([1, 2, 3, 9], [8, 1, 2, 3]) == [(0, 1), (1, 2), (2, 3)]


def text_of(*lines):
    return "\n".join(f"{x} one two three four five" if len(x) == 1 else x for x in lines)


PAIRS = [
    (1, text_of("a", "xy", "b", "c")),
    (2, text_of("n", "a", "xy", "zz", "b")),
    (3, None),
    (4, ""),
    (5, text_of("xy", "d")),
    (5, text_of("xy", "d")),
    (6, text_of("c")),
    (7, text_of("b", "a")),
    (8, text_of("d", "xy")),
    (None, text_of("e")),
    (9, text_of("e", "e")),
]
ALIGNED = {
    1: text_of("a", "xy", "b", "c"), 2: text_of("n", "zz"), 3: None, 4: "", 5: text_of("xy", "d"),
    6: "", 7: text_of("a"), 8: "xy", None: text_of("e"), 9: text_of("e"),
}


def test_aligned_blocks_go_from_the_later_document(docs_of):
    found = [(r.row.doc_id, r.kept) for r in line_dedup.remove_lines(docs_of(PAIRS)).collect()]
    assert len(found) == len(PAIRS)
    assert dict(found) == ALIGNED


def test_frequent_lines_go_from_all_but_their_first_owner(docs_of):
    pairs = [(k, text_of(f"own {k} words of this one document", "f", "xy")) for k in range(40)]
    found = line_dedup.remove_lines(docs_of(pairs), line_dedup.Settings(rare=10)).collect()
    assert {r.row.doc_id: r.n_removed for r in found} == {k: int(k > 0) for k in range(40)}


def test_frequent_lines_are_aligned_like_rare_ones(docs_of):
    copy = text_of("f", "xy", "", "g")
    pairs = [(k, copy) for k in range(150)]
    pairs += [(200, text_of("g", "own words of this one document", "f"))]
    found = line_dedup.remove_lines(docs_of(pairs)).collect()
    assert {r.row.doc_id: r.n_removed for r in found} == {0: 0, **{k: 4 for k in range(1, 150)}, 200: 1}
    assert {r.doc_id for r in line_dedup.drop_duplicate_lines(docs_of(pairs)).collect()} == {0, 200}


def all_pairs(pairs, words=5):
    """Lines deleted from each document by aligning it with every earlier one."""
    docs = sorted({(i, t or "") for i, t in pairs}, key=lambda d: (d[0] is not None, d[0] or 0))
    lines = [(i, t, [x.strip(" ") for x in t.split("\n")]) for i, t in docs]
    out = {}
    for k, (i, t, own) in enumerate(lines):
        counts = [len(x.split()) for x in own]
        gone = set()
        for j, _, other in lines[:k]:
            if j != i:
                gone.update(line_dedup.aligned_blocks(other, own, counts, words))
        out[i, t] = gone
    return out


def test_a_moved_line_goes_with_the_document_that_holds_it_alone(docs_of):
    """Document 3 is out of order against 1, its first owner; 2 holds the line that stays."""
    pairs = [(1, text_of("x", "y")), (2, text_of("x")), (3, text_of("y", "x")), (4, text_of("y"))]
    found = {r.row.doc_id: r.kept for r in line_dedup.remove_lines(docs_of(pairs)).collect()}
    assert found == {1: text_of("x", "y"), 2: "", 3: "", 4: ""}


@pytest.mark.parametrize("seed", range(3))
def test_deleted_lines_against_alignment_of_all_pairs(docs_of, seed):
    """Nothing is deleted that no pair would delete, and hardly anything stays that one would."""
    rnd = random.Random(seed)
    letters = "abcdefghijklmnop"
    pairs = [(k, text_of(*rnd.choices(letters, k=rnd.randrange(1, 7)))) for k in range(60)]
    expected = all_pairs(pairs)
    found = line_dedup.duplicate_lines(docs_of(pairs)).collect()
    texts = {i: t for i, t in pairs}
    got = {(r.id, texts[r.id]): set(r.gone) for r in found}
    assert all(lines <= expected[d] for d, lines in got.items())
    assert sum(map(len, got.values())) >= 0.9 * sum(map(len, expected.values()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t中あไé\u3000x", max_size=60), max_size=6))
def test_words_of_lines_against_a_pattern(texts):
    word = (
        r"[\p{Han}\p{Hiragana}\p{Katakana}]{1,2}|[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{1,4}"
        r"|[^\p{White_Space}\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{1,24}"
    )
    if texts:
        found = line_dedup.line_words(texts, *line_dedup.character_classes())
        assert [c.tolist() for c in found] == [[len(regex.findall(word, x)) for x in t.split("\n")] for t in texts]


LISTS = [
    "eggs\nmilk\nflour and salt\nbread\nbutter\ntea",
    "alpha\tbeta\tgamma\tdelta\tepsilon",
    "我们今天在城里看了一场很好的电影",
    "昨日は友達と\n映画を見に\n行きました",
    "https://example.org/a/long/path/without/any/space/in/it?with=parameters&and=more&of=them&to=the&end=of&the=line",
]


@pytest.mark.parametrize("copied", LISTS)
def test_short_lines_and_other_scripts_lead_to_a_comparison(docs_of, copied):
    pairs = [(1, copied), (2, copied), (3, "x\n" + copied + "\ny"), (4, "x\n" + "\ny\n".join(copied.split("\n")) + "\nz")]
    found = {r.row.doc_id: r.kept for r in line_dedup.remove_lines(docs_of(pairs[:3])).collect()}
    assert found == {1: copied, 2: "", 3: "x\ny"}


def test_blocks_under_five_words_stay(docs_of):
    pairs = [(1, "one two\n\nthree four"), (2, "one two\n\nthree four"), (3, "a b\nc\nx\nd e"), (4, "a b\nc\ny\nd e"), (5, "我们\n今天")]
    pairs.append((6, pairs[-1][1]))
    assert {r.n_removed for r in line_dedup.remove_lines(docs_of(pairs)).collect()} == {0}


def test_runs_are_the_fewest_lines_with_the_words(spark):
    rnd = random.Random(3)
    hashes = [rnd.getrandbits(63) for _ in range(4)]
    rows = [(k, 0, rnd.choices(hashes, k=n), [rnd.randrange(7) for _ in range(n)]) for k, n in enumerate([0, 1, 30, 9, 50])]
    table = spark.createDataFrame(rows, "id long, th long, hashes array<long>, words array<int>").coalesce(1)
    found, expected = {}, {}
    for r in line_dedup._runs(table, 5).collect():
        found.setdefault(r.line, set()).add((r.id, r.place, r.last_place))
    for k, _, hashes, words in rows:
        for i in range(len(words)):
            ends = [j for j in range(i, len(words)) if sum(words[i : j + 1]) >= 5]
            if words[i] and ends:
                expected.setdefault(tuple(hashes[i : ends[0] + 1]), set()).add((k, i, ends[0]))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_slices_of_a_first_owner_do_not_change_the_result(docs_of, monkeypatch):
    pairs = [(k, text_of("f", "xy", f"own {k} words of this one document", "g")) for k in range(30)]
    found = []
    for size in (line_dedup.SLICE_PLACES, 2):
        monkeypatch.setattr(line_dedup, "SLICE_PLACES", size)
        found.append(sorted((r.row.doc_id, r.kept) for r in line_dedup.remove_lines(docs_of(pairs)).collect()))
    assert found[0] == found[1] and found[0][1][1] == "own 1 words of this one document"


def test_stage_keeps_columns_and_drops_emptied_documents(docs_of):
    docs = docs_of([*PAIRS, (10, "\n" + text_of("a") + "\n \t")])
    found = line_dedup.drop_duplicate_lines(docs)
    assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
    rows = found.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in PAIRS if i != 6)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert line_dedup.drop_duplicate_lines(docs_of([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_bucket_lengths_waste_the_least(histogram, buckets):
    def cost(ends):
        return sum(n * min(e for e in ends if e >= x) for x, n in histogram.items())

    lengths = sorted(histogram)
    choices = (
        {*some, lengths[-1]} for r in range(min(buckets, len(lengths))) for some in itertools.combinations(lengths[:-1], r)
    )
    ends = packing.bucket_lengths(histogram, buckets)
    assert len(ends) <= buckets and cost(ends) == min(map(cost, choices))


@pytest.mark.parametrize("share", [20_000, 50])
def test_batches_keep_the_budget_and_are_full(spark, share):
    rnd = random.Random(9)
    rows = [(k, rnd.choice([0, 3, 7, rnd.randrange(200)])) for k in range(700)] + [(900, None), (901, 500), (901, 500), (None, 5)]
    table = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    chosen = packing.Settings(budget=256, buckets=5, share=share, least_shares=4)
    found = packing.pack(table, chosen).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted((str(i), n or 0) for i, n in rows)
    batches = {}
    for r in found:
        batches.setdefault(r.batch, []).append(r)
    partial = 0
    for held in batches.values():
        length = held[0].bucket_tokens
        fit = max(1, 256 // max(length, 1))
        assert {r.bucket_tokens for r in held} == {length} and all(r.n_tokens <= length for r in held)
        assert sorted(r.slot for r in held) == list(range(len(held))) and len(held) <= fit
        partial += len(held) < fit
    assert partial <= 5
    assert sum(r.n_tokens > 256 for r in found) == sum(len(h) == 1 and h[0].n_tokens > 256 for h in batches.values())


def test_packing_documents_and_empty_tables(docs_of):
    assert packing.pack_documents(docs_of([])).count() == 0
    found = packing.pack_documents(docs_of([(1, None), (2, "some words"), (2, "some words")])).collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 2]
