import random

import pytest

#: Extra columns named like the operators' own.
CLASH = "id long, th long, body string, row string, kept string, lines int, fp long, gone int, n_tokens int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with extra columns that clash."""

    def make(pairs, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs]
        if extra:
            schema += ", " + CLASH
            rows = [(*r, -1, -2, "x", "y", "z", 0, 0, 0, 0) for r in rows]
        return spark.createDataFrame(rows, schema)

    return make


def words(rnd, n, lexicon=400):
    return " ".join(f"w{rnd.randrange(lexicon)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and blank texts, repeated rows and texts, a very long text, shared passages."""
    rnd = random.Random(5)
    passage, line = words(rnd, 90), words(rnd, 12)
    pairs = [(1, None), (2, ""), (3, " \n\t "), (None, "no id at all"), (None, None), (4, "one"), (5, "one two")]
    pairs += [(6, "é ü 中文   x\x1cy"), (7, "a" * 3000), (8, "ab" * 1500), (9, (line + "\n") * 60)]
    pairs += [(20 + i, words(rnd, rnd.randrange(200))) for i in range(12)]
    pairs += [(40 + i, f"{words(rnd, 40)} {passage} {words(rnd, 30 + i)}") for i in range(6)]
    pairs += [(60 + i, f"{words(rnd, 30)}\n{line}\n{words(rnd, 30)}") for i in range(6)]
    copy = words(rnd, 150)
    pairs += [(80 + i, copy) for i in range(5)] + [(85, copy + " more"), (80, copy)]
    pairs += [(99, words(rnd, 20_000, 3000))]
    return pairs
