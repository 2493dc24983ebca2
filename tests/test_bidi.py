"""Bidirectional levels and PRECIS profiles."""

import pytest
from pyspark.sql import functions as F

from glyphloom.functions import bidi, precis


@pytest.mark.parametrize("text,levels", [
    ("abc", [0, 0, 0]), ("אב", [1, 1]), ("a אב b", [0, 0, 1, 1, 0, 0]), ("א 12", [1, 1, 2, 2]), ("a אב 12", [0, 0, 1, 1, 1, 2, 2]), ("א(b)ג", [1, 1, 2, 1, 1]), ("a(ב)c", [0, 0, 1, 0, 0]),
    ("‫a‬", [2, 2, 0]), ("⁧a⁩b", [0, 2, 0, 0]), ("ا1", [1, 2]), ("12 אב", [2, 2, 1, 1, 1]), ("a ", [0, 0]), ("א ", [1, 1]), ("‮ab‬", None),
])
def test_levels(text, levels):
    got, _ = bidi.levels_of(text)
    if levels is None:
        assert got[1:3] == [1, 1]
    elif text[0] in "‫⁧":
        assert got[1] == levels[1] and len(got) == len(text)
    else:
        assert got == levels


def test_columns(spark):
    d = spark.createDataFrame([("abc",), ("",), (None,), ("a אב",), ("1‮ab",)], "t string").select("t", bidi.resolve("t").alias("r"))
    got = {r["t"]: r["r"] for r in d.collect()}
    assert got["abc"]["visual"] == "abc" and got[""]["levels"] == [] and got[None] is None and got["a אב"]["visual"] == "a בא" and got["1‮ab"]["visual"] == "1ba"


def test_precis(spark):
    f = lambda v, k: spark.createDataFrame([(v,)], "t string").select(k(F.col("t")).alias("r")).first()["r"]
    assert f("Ａbc", precis.username)["value"] == "abc" and f("a b", precis.username)["error"] == "disallowed U+0020" and f("", precis.username)["error"] == "empty"
    assert f("Abc", lambda t: precis.username(t, False))["value"] == "Abc" and f("aא", precis.username)["error"] == "bidi"
    assert f("pass word", precis.opaque_string)["value"] == "pass word" and f("a\x01", precis.opaque_string)["value"] is None and f(None, precis.opaque_string) is None
