"""Byte-level BPE, fill-in-the-middle and vector codes against plain versions."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import sha
from hypothesis import given, settings
from hypothesis import strategies as st

from tastegraph.llm import byte_bpe, fill_middle, vector_codes

# ---- byte-level BPE ------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(byte_bpe.rank_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(byte_bpe.rank_path()), byte_bpe.character_classes()).encoder()


ODD = [
    "", "'", "''s", "'s's 're", "x'll 'll'v", " 'd", "\n'd", "a  b", "a \n b", "a \n", "   ", "　a", "a b", "12ab3",
    "a" * 5000, "ab" * 900 + " " * 700, "!" * 300, "é中🙂‍'tx", "<|endoftext|>", "\x00\x1c\x85", "ſ'S 'T", "²½Ⅷ",
]


def test_tokens_equal_the_library_and_decode_to_the_text(docs_of, odd_pairs, library):
    rnd = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'re", "'", "l", "'ll", "ve", "1", "२", "!", "\r", "\x00", "中", "ﬁ", "don't"]
    pairs = odd_pairs + list(enumerate(ODD, 600))
    pairs += [(1000 + k, "".join(rnd.choices(parts, k=rnd.randrange(30)))) for k in range(500)]
    docs = docs_of(pairs)
    encoded = byte_bpe.encode(docs)
    expected = sorted((str(i), library.encode_ordinary(t or "")) for i, t in pairs)
    rows = byte_bpe.decode(encoded.withColumn("extra col", encoded.doc_id)).collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == expected
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in rows) == sorted((str(i), (t or "").encode()) for i, t in pairs)
    together = byte_bpe.encode(docs, decoded=True).collect()
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in together) == sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in rows)
    sizes = [len(t) for t in byte_bpe.read_ranks(byte_bpe.rank_path())]
    for r in encoded.collect():
        assert r.offsets == [sum(sizes[i] for i in r.ids[:k]) for k in range(len(r.ids))] or len(r.ids) > 500
    assert byte_bpe.encode(docs_of([])).count() == byte_bpe.decode(byte_bpe.encode(docs_of([]))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("a 's\nltredvm1!")), max_size=40), max_size=5))
def test_any_texts_equal_the_library(encoder, library, texts):
    found = encoder.encode([t.encode() for t in texts]) if texts else []
    assert [ids.tolist() for ids, _ in found] == [library.encode_ordinary(t) for t in texts]


def test_states_do_not_depend_on_blocks():
    rnd, table = np.random.default_rng(4), byte_bpe.transitions()
    classes = rnd.integers(0, 12, 1000).astype(np.uint8)
    state, plain = byte_bpe.AT_START, []
    for c in classes.tolist():
        state = int(table[c, state])
        plain.append(state)
    for block in (1, 3, 64, 5000):
        assert byte_bpe.scan_states(classes, table, block).tolist() == plain


def test_long_and_short_merges_agree(encoder):
    rnd = random.Random(5)
    merge = encoder.merge
    for size in (2, 9, 40, 64):
        pieces = ["".join(rnd.choices("abcdeiost", k=size)).encode() for _ in range(30)]
        width = -(-size // 8) * 8
        assert merge.merge_short(pieces, width) == [merge.merge_long(p) for p in pieces]


def test_tokens_do_not_depend_on_the_cache(encoder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 5)
    texts = ["some unlikelyword here", "another unlikelyword there", "zzxqk zzxqk"]
    for _ in range(3):
        assert [i.tolist() for i, _ in encoder.encode([t.encode() for t in texts])] == [library.encode_ordinary(t) for t in texts]


# ---- fill in the middle -----------------------------------------------------------


def plain_middle(ident, text, seed=1):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_a_plain_version(docs_of, odd_pairs):
    rnd = random.Random(6)
    parts = ["a", "the", " ", "\n", "é", "中", "1", "🙂", "ABC", "x" * 50, "\r\n", "$1", "\\"]
    pairs = odd_pairs + [(900, "a <P> b"), (901, "<M>"), (902, "< P>"), (903, "a" * 50_000), (904, "é" * 20_000)]
    shared = "".join(rnd.choices(parts, k=4000))
    pairs += [(1000 + k, "".join(rnd.choices(parts, k=rnd.randrange(80)))) for k in range(300)]
    pairs += [(2000 + k, "".join(rnd.choices(parts, k=k)) + shared) for k in range(20)]
    found = fill_middle.restore(fill_middle.fill_in_middle(docs_of(pairs))).collect()
    got = sorted((str(r.doc_id), (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.restored) for r in found)
    assert got == sorted((str(i), plain_middle(i, t or ""), t or "") for i, t in pairs)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs_of([])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB é中\n1", max_size=300), min_size=1, max_size=6), st.integers(0, 5))
def test_chunk_counts_locate_every_token(texts, bits):
    chunks = fill_middle.Chunks()
    window, longest, cut = fill_middle.WINDOW, fill_middle.LONGEST, fill_middle.CUT_BITS
    fill_middle.WINDOW, fill_middle.LONGEST, fill_middle.CUT_BITS = 4, 20, bits
    try:
        found = fill_middle.documents([t.encode() for t in texts], chunks)
    finally:
        fill_middle.WINDOW, fill_middle.LONGEST, fill_middle.CUT_BITS = window, longest, cut
    for text, document in zip(texts, found):
        tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        assert b"".join(c.content for c in document.chunks) == text.encode()
        places = [("".join(tokens[:k])) for k in range(len(tokens) + 1)]
        assert [document.place(k) for k in range(len(tokens) + 1)] == [(len(p.encode()), len(p)) for p in places]


def test_a_kept_summary_is_used_for_the_same_content_alone():
    chunks = fill_middle.Chunks()
    first = chunks.summary(7, b"ab cd")
    assert chunks.summary(7, b"ab cd") is first
    other = chunks.summary(7, "é 1".encode())
    assert (other.chars, other.starts, other.letter_first, other.letter_last) == (3, 3, False, False)


def test_shared_passages_fall_into_the_same_chunks():
    rnd = random.Random(8)
    shared = "".join(rnd.choices("abcdefghij klmno", k=60_000))
    texts = [("x" * k + " " + shared).encode() for k in (0, 7, 100)]
    found = fill_middle.documents(texts, fill_middle.Chunks())
    contents = [{c.content for c in d.chunks} for d in found]
    assert len(contents[0] & contents[1] & contents[2]) >= len(contents[0]) - 3


def test_a_batch_of_texts_is_not_held_whole():
    """What a worker allocates does not grow with the rows that Spark hands over together."""
    import tracemalloc

    text = " ".join(f"w{k}" for k in range(900)).encode()
    ids = pa.array(range(4000), pa.int64())
    batch = pa.record_batch([ids, pa.array([text] * 4000, pa.binary()), *[ids] * 4], names=["doc_id", "body", "h1", "h2", "h3", "h4"])
    tracemalloc.start()
    try:
        rows = sum(found.num_rows for found in fill_middle.rearranged(iter([batch]), fill_middle.Settings()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 4000
    assert peak < len(text) * 4000


# ---- vector codes -------------------------------------------------------------------


def plain_codes(rows, s):
    """Codes by looking at every entry, in Python's integers."""
    kept = [(i, lab, [int(np.floor(s.scale * x)) for x in v]) for i, lab, v in rows
            if v and len(v) % s.parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    least = {}
    for i, _, q in kept:
        if i is not None:
            least[i] = min(q, least.get(i, q))
    if not least:
        return [], None
    seeds = [least[i] for i in sorted(least)[: s.entries]]
    size = len(seeds[0])
    seeds = [q for q in seeds if len(q) == size]
    kept = [k for k in kept if len(k[2]) == size]
    width = size // s.parts
    cut = [[q[p * width : (p + 1) * width] for p in range(s.parts)] for _, _, q in kept]
    books = [[q[p * width : (p + 1) * width] for q in seeds] for p in range(s.parts)]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return min(range(len(book)), key=lambda k: (far[k], k)), min(far)

    for _ in range(s.rounds):
        for p in range(s.parts):
            members = {}
            for row in cut:
                members.setdefault(nearest(row[p], books[p])[0], []).append(row[p])
            for k, own in members.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for (i, lab, _), row in zip(kept, cut):
        codes = [nearest(x, book) for x, book in zip(row, books)]
        out.append((i, lab, "".join(f"{k:02x}" for k, _ in codes), sum(d for _, d in codes)))
    total = {}
    for _, lab, _, d in out:
        total[lab] = total.get(lab, 0) + d
    return [(str(i), code, d, total[lab]) for i, lab, code, d in out], books


SCHEMA = "vec_id long, label string, embedding array<float>, q int, code int, total int"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("entries", [4, 256])
def test_codes_against_a_plain_version(spark, entries):
    rnd = np.random.default_rng(9)
    rows = [(int(k), None if k % 7 == 0 else f"l{k % 3}", rnd.normal(size=8).round(3).astype(np.float32).tolist()) for k in rnd.permutation(120)]
    rows += [(200 + k, "l1", rows[3][2]) for k in range(15)] + [rows[5], (rows[5][0], "l0", rows[6][2]), (None, "l2", rows[7][2])]
    rows += [(300, "l1", None), (301, "l1", []), (302, "l1", [1.0, None] * 4), (303, "l1", [float("nan")] * 8)]
    rows += [(304, "l1", [float("inf")] + [0.0] * 7), (305, "l1", [1.0] * 6), (306, "l1", [1.0] * 4), (307, "l1", [0.0] * 8)]
    s = vector_codes.Settings(entries=entries)
    codes, books = vector_codes.compress(table_of(spark, rows), s)
    expected, plain_books = plain_codes(rows, s)
    assert books.tolist() == plain_books
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in codes.collect()) == sorted(expected)
    back = vector_codes.decode(codes, books).first()
    assert back.vector == [x for p in range(4) for x in books[p][int(back.code[2 * p : 2 * p + 2], 16)].tolist()]


def test_codes_of_nothing(spark):
    for rows in ([], [(1, "a", None)], [(None, "a", [1.0] * 4)]):
        codes, books = vector_codes.compress(table_of(spark, rows))
        assert books is None and codes.count() == 0 and codes.columns == ["vec_id", "code", "error", "label_error"]


def test_very_large_components_stay_in_range(spark):
    rows = [(1, "a", [3e38, -3e38, 0.0, 1.0]), (2, "a", [0.0] * 4)]
    codes, books = vector_codes.compress(table_of(spark, rows))
    assert books.max() == vector_codes.LARGEST and books.min() == -vector_codes.LARGEST
    assert all(r.error >= 0 for r in codes.collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(0, 10_000), st.sampled_from([2, 30, 5000]))
def test_equal_average_search_is_exact(entries, dim, seed, spread):
    rnd = np.random.default_rng(seed)
    book, parts = rnd.integers(-spread, spread, (entries, dim)), rnd.integers(-spread, spread, (50, dim))
    search = vector_codes.EqualAverage(book)
    code, best = search.nearest(parts)
    far = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert code.tolist() == far.argmin(axis=1).tolist() and best.tolist() == far.min(axis=1).tolist()


def test_search_looks_at_few_entries():
    rnd = np.random.default_rng(11)
    centers = rnd.integers(-1000, 1000, (256, 16))
    search = vector_codes.EqualAverage(centers)
    search.nearest(centers[rnd.integers(0, 256, 500)] + rnd.integers(-20, 20, (500, 16)))
    assert search.looked_at < 500 * 256 / 4


def test_digest_of_codebooks():
    books = np.arange(8).reshape(2, 2, 2)
    assert vector_codes.codebook_text(books) == "0,1,2,3,4,5,6,7"
    assert sha(vector_codes.codebook_text(books).encode()) == hashlib.sha256(b"0,1,2,3,4,5,6,7").hexdigest()
