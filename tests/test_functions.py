import math

import pytest
from pyspark.sql import functions as F

from tastegraph.functions import ids, scores, text


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect()]


def test_clean_labels(spark):
    rows = [("Food & Wine, x &y, (Bars)",), (None,), ("",), (" A/B\t, 　C",)]
    kept = values(spark, rows, "c string", text.clean_labels(F.col("c")))
    assert kept == [["food wine", "xy", "bars"], None, [""], ["a b", "c"]]
    dropped = values(spark, rows, "c string", text.clean_labels(F.col("c"), keep_empty=False))
    assert dropped[2] == []


def test_clean_labels_equals_python_recipe(spark):
    strings = ["a  b,c", "Café &Bar / (x),  y ", ",,", " & ", "A((b))  C,d\n", "x   &  y"]

    def recipe(s):
        for old, new in [("&", " "), ("/", " "), ("(", ""), (")", ""), ("  ", "")]:
            s = s.replace(old, new)
        return [piece.strip().lower() for piece in s.split(",")]

    found = values(spark, [(s,) for s in strings], "c string", text.clean_labels(F.col("c")))
    assert found == [recipe(s) for s in strings]


def test_strip_equals_python_for_every_whitespace(spark):
    rows = [(chr(c) + "x" + chr(c),) for c in range(1, 0x3100) if chr(c).isspace()]
    assert set(values(spark, rows, "c string", text.strip(F.col("c")))) == {"x"}
    assert len(text.WHITESPACE) == len(rows)


def test_friends(spark):
    rows = [("a,\tb ,",), ("None",), ("",), (None,)]
    assert values(spark, rows, "f string", text.friend_ids(F.col("f"))) == [
        ["a", "b", ""], ["None"], [""], None
    ]
    assert values(spark, rows, "f string", text.num_friends(F.col("f"))) == [3, 1, 1, None]


def test_years_on_site(spark):
    assert values(
        spark, [("2010-05-01 12:00:00",)], "s string", text.years_on_site(F.col("s"), 2022)
    ) == [12]


def test_poly_hash(spark):
    def recipe(s):
        h = 0
        for ch in s:
            h = h * 131 + ord(ch)
        return h & 0x7FFFFFFF

    strings = ["abc", "", "b17", "Café", "日本語", "😀x", "z" * 200]
    found = values(
        spark, [(s,) for s in strings], "s string",
        ids.poly_hash(F.col("s")), ids.poly_bucket(F.col("s")),
    )
    assert found == [(recipe(s), recipe(s) % 10) for s in strings]
    assert found[0] == (1677554, 4)


BLENDS = [
    (6.0, 4.0, 4.8, 4.4),
    (5.2, 5.1, 5.0, 5.0),
    (0.5, 0.9, 1.0, 1.0),
    (9.0, 4.0, 5.0, 4.4),
    (-3.0, 2.0, 1.0, 1.6),
    (3.0, 4.0, 3.6, 3.6),
]


@pytest.mark.parametrize("clamp_inputs,at", [(False, 2), (True, 3)])
def test_blend(spark, clamp_inputs, at):
    found = values(
        spark, [row[:2] for row in BLENDS], "x double, c double",
        scores.blend(F.col("x"), F.col("c"), clamp_inputs=clamp_inputs),
    )
    assert found == pytest.approx([row[at] for row in BLENDS])


def test_blend_keeps_nan(spark):
    nan = float("nan")
    for clamp_inputs in (False, True):
        found = values(
            spark, [(nan, 3.0), (3.0, nan), (nan, nan), (9.0, nan)], "x double, c double",
            scores.blend(F.col("x"), F.col("c"), clamp_inputs=clamp_inputs),
        )
        assert all(math.isnan(v) for v in found)


def test_blend_three(spark):
    found = values(
        spark, [(2.0, 4.0, -1.0), (2.0, 4.0, 5.0)], "x double, c double, n double",
        scores.blend_three(F.col("x"), F.col("c"), F.col("n")),
    )
    assert found == pytest.approx([(1.6 + 0.4) / 0.9, 2.5])
    equal = values(
        spark, [(2.0, 4.0, -1.0)], "x double, c double, n double",
        scores.blend_three(F.col("x"), F.col("c"), F.col("n"), weights=(0.5, 0.5, 0.0)),
    )
    assert equal == pytest.approx([3.0])
