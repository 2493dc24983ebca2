"""Line and sentence breaks, domain names and registries, against the ICU library of the session's JVM."""

import random
import unicodedata as ud

import pytest
from pyspark.sql import functions as F

from glyphloom.functions import idna, registry, segment, ucd
from glyphloom.functions import text as T


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first()["x"]


def icu_breaks(spark, kind, s):
    it = getattr(spark.sparkContext._jvm.com.ibm.icu.text.BreakIterator, kind)(spark.sparkContext._jvm.java.util.Locale.ROOT)
    it.setText(s)
    units = {0: 0}
    for i, x in enumerate(s):
        units[max(units) + 1 + (x > "￿")] = i + 1
    out = []
    while (at := it.next()) != -1:
        out.append(units[at])
    return out


#: A few characters of the classes whose rules the two libraries' Unicode versions share (Hebrew letters' changed).
LINE = "a bé .,;:!?()[]{}\"'%$#@/-‐—–«»“”‘ ​⁠‍́̈\n\r \t0159一あ、「！…각가각￼´€\U0001f1e6\U0001f1fa\U0001f466\U0001f3fd\U0001f468กᬅ◌᭄"


def test_line_breaks(spark):
    r = random.Random(4)
    for _ in range(800):
        s = "".join(r.choice(LINE) for _ in range(r.randint(1, 12))).replace("ก", "a")
        assert segment.line_breaks(s) == icu_breaks(spark, "getLineInstance", s), ascii(s)
    assert segment.line_breaks("") == [] and one(spark, segment.lines, "a b\nc-d") == ["a ", "b\n", "c-", "d"] and one(spark, segment.line_count, None) is None


def test_sentence_breaks(spark):
    r = random.Random(5)
    marks = "aAbB1 .!?\"')(,:;\n\r ­́。אéİ…"
    for _ in range(600):
        s = "".join(r.choice(marks) for _ in range(r.randint(1, 14)))
        assert segment.sentence_breaks(s) == icu_breaks(spark, "getSentenceInstance", s), ascii(s)
    assert one(spark, segment.sentences, "Dr. who? 3.4 is. Yes") == ["Dr. who? ", "3.4 is. ", "Yes"] and one(spark, segment.sentences, "") == []


def test_domain_names(spark):
    """Against ICU's UTS #46, which has all checks but the trailing dot's."""
    j = spark.sparkContext._jvm
    r = random.Random(6)
    parts = ["a", "B", "ß", "ς", "ü", "Ü", "-", "xn--", "xn--bcher-kva", "xn--a", "。", ".", "א", "1", "١", "‍", "‌", "क्", "ب", "­", "Ａ", "Ⅳ", "́", "_", "一", "⾆8", "\U0001f600", "ẞ"]
    count = 0
    for transitional in (False, True):
        get = j.com.ibm.icu.text.IDNA.getUTS46Instance(2 | 4 | 8 | (0 if transitional else 0x30))
        for _ in range(300):
            s = "".join(r.choice(parts) for _ in range(r.randint(1, 6)))
            if s[-1] in ".。" or s.endswith("­"):
                continue
            info, out = getattr(j, "com.ibm.icu.text.IDNA$Info")(), j.java.lang.StringBuilder()
            get.nameToASCII(s, out, info)
            got = idna.process(s, transitional)
            if not info.hasErrors():
                assert (got["ascii"], got["errors"]) == (out.toString(), []), ascii(s)
                count += 1
            else:
                assert got["errors"], (ascii(s), str(info.getErrors()))
    assert count > 80
    assert one(spark, lambda t: idna.idna(t, check_hyphens=False, std3=False), "-a_") == ("-a_", "-a_", [])
    assert one(spark, idna.idna, "a..b")["errors"] == ["empty-label", "label-length"] and "empty" in one(spark, idna.idna, "")["errors"]
    assert one(spark, idna.dispositions, "aAß­") == ["valid", "mapped", "deviation", "ignored", "disallowed"]
    assert one(spark, lambda t: idna.map_domain(t, True), "ẞA") == ("ssa", False)


def test_tables_reach_workers(spark, tmp_path):
    """A data folder's table decides in columns as on the driver; a table whose file is missing is an error."""
    (tmp_path / "confusables.txt").write_text("007A ;\t0071 ;\tMA\n")
    ucd.use_data_dir(str(tmp_path))
    try:
        assert T.skeleton_of("zz") == "qq" == one(spark, T.skeleton, "zz")
        with pytest.raises(FileNotFoundError):
            T.restriction_level("t")
    finally:
        ucd.use_data_dir(None)
    assert ucd.origin() == "icu" and one(spark, T.skeleton, "zzа") == "zza"
    assert T.level_of("aж") == one(spark, T.restriction_level, "aж")


def test_confusables(spark):
    """Skeletons without case folding agree with ICU's on characters without default ignorables."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    table = ucd.confusables()
    assert len(table) > 5000
    r = random.Random(7)
    some = [*table]
    for _ in range(400):
        s = "".join(r.choice(some) for _ in range(4))
        assert ud.normalize("NFD", "".join(table.get(x, x) for x in ud.normalize("NFD", s))) == checker.getSkeleton(s)


def test_registered_sequences(spark):
    cases = {
        "\U0001f1e9\U0001f1ea": "RGI_Emoji_Flag_Sequence", "\U0001f44b\U0001f3fb": "RGI_Emoji_Modifier_Sequence", "1️⃣": "Emoji_Keycap_Sequence", "\U0001f600": "Basic_Emoji",
        "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f": "RGI_Emoji_Tag_Sequence", "\U0001f468‍\U0001f4bb": None, "❤️": "Basic_Emoji",
    }
    others = ["a", "\U0001f1e6\U0001f1e6", "\U0001f600\U0001f3fb", "", "❤"]
    d = spark.createDataFrame([(t,) for t in [*cases, *others]], "t string")
    rows = d.select("t", registry.is_rgi_emoji("t").alias("rgi"), *[registry.is_registered("t", k).alias(k) for k in registry.KINDS]).collect()
    for r in rows:
        assert r["rgi"] == (r["t"] in cases) and [k for k in registry.KINDS if r[k]] == ([cases[r["t"]]] if cases.get(r["t"]) else [])
    assert one(spark, lambda t: registry.unregistered_bases(t, 0xFE0F), "a️❤️#️") == [0]


def test_selector_payloads(spark):
    def spell(data):
        return "x" + "".join(chr(0xFE00 + n) for b in data for n in (b >> 4, b & 15))

    cases = {b"eval(1)": "javascript", b"curl x": "shell", b"hello\n": "ascii", b"\x00\xff": "binary", b"": "empty"}
    d = spark.createDataFrame([(spell(x) + "᠋",) for x in cases], "t string").select(registry.selector_bytes("t").alias("b")).withColumn("hint", registry.executable_hint("b"))
    assert {bytes(r["b"]): r["hint"] for r in d.collect()} == cases
    assert one(spark, registry.selector_bytes, "︁\U000e0100︅") == bytes([(1 << 4) | 16])


def test_orientation_and_names(spark):
    assert one(spark, registry.orientations, "a一、ー") == ["R", "U", "Tu", "Tr"]
    assert one(spark, registry.upright, "a一") == [False, True] and one(spark, registry.needs_substitution, "a、ー") == [1, 2]
    names = {r["short"]: r["long"] for r in registry.property_names(spark).collect()}
    assert names["gc"] == "General_Category" and names["lb"] == "Line_Break" and names["Alpha"] == "Alphabetic"
    assert {r["short"]: r["long"] for r in registry.property_names(spark, "lb").collect()}["QU"] == "Quotation"


def test_single_characters(spark):
    assert one(spark, registry.compatibility_tag, "ﬁＡa") == ["compat", "wide", None] and one(spark, registry.canonical_mapping, "éaÅ") == ["é", None, "Å"]
    assert one(spark, registry.excluded_from_composition, "क़éΩ") == [True, False, True]
    d = spark.createDataFrame([("e", "́"), ("a", "b"), ("क", "़")], "a string, b string")
    assert [r["x"] for r in d.select(registry.primary_composite("a", "b").alias("x")).collect()] == ["é", None, None]
    assert one(spark, lambda t: segment.property_values(t, "GRAPHEMECLUSTERBREAK"), "á‍") == ["XX", "EX", "ZWJ"]
    assert one(spark, registry.contains_glitch_token, "say SolidGoldMagikarp") and not one(spark, registry.contains_glitch_token, "petertodd")
    assert one(spark, lambda t: T.display_width(t, 2), "éα一\U0001f468‍\U0001f4bb") == 8 and one(spark, lambda t: T.display_width(t, 1, False), "\U0001f468‍\U0001f4bb") == 4


def test_ideographs(spark, tmp_path):
    (tmp_path / "Unihan_Variants.txt").write_text("U+4E07\tkTraditionalVariant\tU+842C\nU+842C\tkSimplifiedVariant\tU+4E07\n")
    (tmp_path / "Unihan_NumericValues.txt").write_text("U+4E00\tkPrimaryNumeric\t1\nU+58F9\tkAccountingNumeric\t1\n")
    ucd.use_data_dir(str(tmp_path))
    try:
        assert one(spark, lambda t: registry.variants(t, "kTraditionalVariant"), "万a") == ["萬", ""]
        assert one(spark, lambda t: registry.ideograph_numbers(t, "kAccountingNumeric"), "壹一") == [1.0, None]
    finally:
        ucd.use_data_dir(None)
    assert one(spark, registry.ideograph_numbers, "三x") == [3.0, None]


def test_rotated_count(spark):
    """One pass over a long text counts what upright() tells apart, in a small part of its time."""
    cases = ["", "a", "a一、ー\U0001f600é©", "힣ｂ“\U000e0041", "plain é"]
    d = spark.createDataFrame([(x,) for x in cases], "t string").select(registry.rotated_count("t").alias("n"), registry.upright("t").alias("u"), registry.orientations("t").alias("o"))
    assert [r["n"] for r in d.collect()] == [r["u"].count(False) for r in d.collect()] == [0, 1, 3, 2, 7]
    assert [len(r["o"]) for r in d.collect()] == [len(x) for x in cases]
    assert one(spark, registry.rotated_count, None) is None and one(spark, registry.orientations, None) is None
