import pytest
from pyspark.sql import functions as F

from glyphloom.functions import validate as V


@pytest.mark.parametrize("f,value,want", [
    (V.first_forbidden_control, "é\x01", 2), (V.first_forbidden_control, "a\n\t", None), (V.is_printable, "plain é", True), (V.is_printable, "a​", False), (V.is_printable, "é", False),
    (V.is_ascii_identifier, "a_1", True), (V.is_ascii_identifier, "a\n", False), (V.is_flag_sequence, "\U0001f1eb\U0001f1f7", True), (V.is_keycap_sequence, "1️⃣", True), (V.is_modifier_sequence, "\U0001f44b\U0001f3fb", True),
    (V.is_modifier_sequence, "a\U0001f3fb", False), (V.is_tag_sequence, "\U0001f3f4\U000e0067\U000e007f", True), (V.is_zwj_sequence, "a‍b", True), (V.is_zwj_sequence, "a‍‍b", False), (V.is_zwj_sequence, "a‍", False),
    (V.is_registered_zwj, "\U0001f468‍\U0001f4bb", True), (V.safe_for_code, "x = 1", True), (V.safe_for_code, "x‮", False), (V.loose_name, "Line_Break -x", "linebreakx"),
])
def test_values(spark, f, value, want):
    d = spark.createDataFrame([(value,), (None,)], "t string").select("t", f("t").alias("x")).collect()
    assert {r["t"]: r["x"] for r in d} == {value: want, None: None}


def test_reasons(spark):
    d = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xe0\x80\x80"),), (bytearray("a‮".encode()),), (bytearray(b"x" * 20),), (bytearray("\x02".encode()),)], "b binary")
    got = [r["x"] and tuple(r["x"]) for r in d.select(V.printable_reason("b", 10).alias("x")).collect()]
    assert got == [None, ("utf8Overlong", 0), ("bidiOverride", 1), ("sizeExceeded", 10), ("forbiddenControl", 0)]
    ids = [r["x"] and r["x"]["code"] for r in spark.createDataFrame([("",), ("1a",), ("a-",), ("a",)], "t string").select(V.identifier_reason("t").alias("x")).collect()]
    assert ids == ["identifierEmpty", "nonIdentifierStartByte", "nonIdentifierContinueByte", None]
    assert spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(V.bounded_blob("b", 2).alias("x")).first()["x"] is None


def test_properties(spark):
    p = spark.createDataFrame([("á",)], "t string").select(V.properties(F.col("t")).alias("p")).first()["p"]
    assert (p[0]["category"], p[0]["scripts"], p[1]["combining"], p[1]["bidi"]) == ("Ll", ["Latn"], 230, "NSM")
