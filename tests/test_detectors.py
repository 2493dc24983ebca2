"""Hazard families on known vectors: code points in hexadecimal, then the sub-threat (none: clear)."""

import pytest
from pyspark.sql import functions as F

from glyphloom.operators import detectors as D

VECTORS = {
    "admissibility-form-drift": [("", None), ("61 64 6D 69 6E", None), ("FB01", "AdmissibilityFormDrift"), ("FF21", "AdmissibilityFormDrift")],
    "ai-watermark-detectability": [
        ("", None), ("61 62 63", None), ("4E2D 6587", None), ("61 202F 62", "NnbspBoundary"), ("61 202F 62 202F 63", "NnbspBoundary"), ("61 202F 62 202F 63 202F 64", "Adversarial"),
        ("61 FE0F 62", "VariationSelectorCarrier"), ("1F600 FE0F", None), ("61 200D 62", "ZwjNonEmoji"), ("1F469 200D 1F52C", None), ("200B 61 200B 61 200B", "Gpt5ZwspModulo"), ("61 202F 200B", "Unknown"),
    ],
    "bidi-control-balance": [("69 66 20", None), ("69 202E 29", "UnbalancedEmbedding"), ("2066 61", "UnbalancedIsolate"), ("202C", "OrphanPop"), ("202A 202C 2066 2069", None), ("202A " * 126, "DepthExceeded")],
    "case-expansion-mismatch": [("", None), ("48 65", None), ("DF", "UpperExpansion"), ("FB01", "UpperExpansion"), ("130", "LowerExpansion")],
    "confusable-bidi-compound": [("", None), ("202E 41 42 43", None), ("430", None), ("202E 430", "ConfusableInOverride"), ("2066 3BF", "ConfusableInIsolate")],
    "covert-display-compound": [("", None), ("202E", None), ("41 FE00", None), ("202E 41 FE00", "BidiPlusUnregisteredVs"), ("202E 41 E0001", "BidiPlusTagBlock")],
    "emoji-zwj-integrity": [
        ("", None), ("1F600", None), ("1F44B 1F3FB", None), ("1F468 200D 1F469 200D 1F467 200D 1F466", None), ("1F468 200D 1F4BB", None), ("1F600 200D 200D 1F600", "DoubleZWJ"), ("1F600 200D 61", "NonEmojiInjection"),
        ("1F468 200D 1F469", "UnregisteredSequence"), ("1F3FB " * 5, "SkinToneOverflow"),
    ],
    "filename-disguise": [
        ("", None), ("64 6F 63 2E 74 78 74", None), ("5D0 5D1 2E 74 78 74", None), ("64 2067 74 78 74 2E 65 2069", "RloFlip"), ("66 2E FF25 FF38", "WidthClassExt"), ("66 2E 65 301 78", "CombiningInExt"), ("61 2E 62 2E 63 2E 64", "MultipleExtensions"),
    ],
    "hash-input-stability": [("", None), ("61 20", "TrailingWhitespace"), ("61 D A", "TrailingWhitespace"), ("65 301", "NormalizationDrift"), ("E9", None), ("65 301 20", "TrailingWhitespace"), ("61 20 62", None)],
    "homoglyph-confusable": [
        ("48 65 6C 6C 6F", None), ("4E 65 74 68 65 72 435 75 6D", "TargetMatch"), ("430 70 70 6C 65", "TargetMatch"), ("E9 74 68 65 72 65 75 6D", "TargetMatch"), ("1D400 1D429 1D429 1D425 1D41E", "TargetMatch"),
        ("FF30 FF41 FF59 FF50 FF41 FF4C", "TargetMatch"), ("65 78 70 72 65 DF", "TargetMatch"), ("65 78 70 72 65 3B2", "TargetMatch"), ("65 301", "DecompositionSwap"), ("1D7D8", "MathAlpha"), ("FF21 FF22", "WidthClass"), ("61 62 436", "CrossScriptMix"), ("70 61 79 70 61 6C" + " 200B" * 200, "TargetMatch"),
    ],
    "identifier-form-drift": [("", None), ("3B1", None), ("1D44E", "IdentifierStatusShift"), ("FF21", "IdentifierStatusShift"), ("FB01", "IdentifierStatusShift"), ("2163", "IdentifierStatusShift")],
    "locale-case-inversion": [("61", None), ("49", "TurkishCaseDivergence"), ("130", "TurkishCaseDivergence"), ("4A 300", "LithuanianCaseDivergence"), ("12E 301", "LithuanianCaseDivergence")],
    "mixed-script-admissibility": [("48 65", None), ("61 62 3B1", "LatinGreek"), ("4E 435", "LatinCyrillic"), ("61 20 62", "RestrictedStatusCp")],
    "nfc-idempotence-witness": [("61", None), ("65 301", "NonNfcForm"), ("FB01", "NonNfkcCompatForm")],
    "noncharacter-control": [("48", None), ("FDD0", "Noncharacter"), ("10FFFF", "Noncharacter"), ("41 0 42", "C0Control"), ("41 80 42", "C1Control"), ("41 9 A D 42", None), ("7F", "C0Control")],
    "normalization-bomb": [("61", None), ("FDFA", "SingleCpBlowup"), ("FB2C", None), ("3300", "NfkdHighExpansion")],
    "renderer-divergence": [
        ("", None), ("4E2D 6587", None), ("1F468 200D 1F469 200D 1F467 200D 1F466", None), ("1F600 FE0F", "VariationSelectorVariance"), ("1F468 200D 1F469", "UnregisteredZwjVariance"), ("61 301 302 303 304", "CombiningStackOverflow"),
        ("301 302 303 304", None), ("FF21", "FullwidthVariance"), ("41 42 5D0 5D1", "MixedDirectionVariance"),
    ],
    "rtl-injection": [("30 31", None), ("43F", None), ("41 202E 42", "RloInLTRField"), ("5D0 42", "FieldTakeover"), ("627 42", "FieldTakeover"), ("41 42 5D0 44", "StrongRTLInLTR"), ("41 5D0 5D1 5D2 5D3 44", "MixedOverflow")],
    "skin-tone-variation-forgery": [("", None), ("1F44B 1F3FB", None), ("1F44B 1F3FB 1F3FC", "StackedSkinTones"), ("41 1F3FB", "InvalidSkinToneTarget"), ("1F600 1F3FB", "InvalidSkinToneTarget"), ("1F600 FE0E", "ForcedTextStyle")],
    "source-display-divergence": [
        ("", None), ("6C 65 74", None), ("E0041 E0042", "TagBlock"), ("41 FE0F", "VariationSelector"), ("48 200B 69", "ZeroWidth"), ("202E 41", "BidiControl"), ("4E 65 74 68 65 72 435 75 6D", "IdentifierHomoglyph"), ("41 FE0F 200B", "Compound"),
    ],
    "stream-safe-violation": [("", None), ("61 301", None), ("61" + " 301" * 30, None), ("61" + " 301" * 31, "StreamSafeOverrun")],
    "surrogate-reassembly": [("", None), ("C3 A9", None), ("F0 9F 98 80", None), ("C0 80", "InvalidStartByte"), ("E0 80 AF", "Overlong"), ("ED A0 80", "Cesu8"), ("C3", "Truncated"), ("F4 90 80 80", "CodepointBeyondMax"), ("C3 28", "InvalidContinuation"), ("E9 100", None)],
    "tag-block-payload": [("48", None), ("E0041 E0042", "DirectAscii"), ("61 E0041", "MixedBlock"), ("E0001 E0041", "LanguageTagRevival"), ("E0001", "BareTagPresent"), ("E007F", "BareTagPresent")],
    "variation-selector-payload": [
        ("41 42", None), ("A9 FE0F", None), ("30 FE00", None), ("41 FE0F", "IllegalTarget"), ("4E00 FE04 FE01", "DirectPayload"), ("FE01 FE01 FE01 FE01", "RepeatedBase"), ("1F600 FE0F FE01", "EmbeddedAfterRegistered"),
    ],
    "width-class-confusion": [("41", None), ("FF21", "FullwidthFold"), ("FF71", "HalfwidthFold")],
    "zero-width-payload": [("61 62", None), ("61 200B 62", "BareZeroWidth"), ("1F468 200D 1F4BB", None), ("61 200B 200D", "BinaryPayload"), ("61 2060", "WordJoinerInjection"), ("202F 61 202F", "AIWatermarkNNBSP"), ("FFF9 61", "AnnotationMisuse")],
    "bip39-canonical": [("61", None), ("61 20", "TrailingWhitespace"), ("41", "MixedCase"), ("61 20 20 62", "WhitespaceAnomaly"), ("E9", "NonNFKD")],
}


def text(hexes):
    return "".join(chr(int(x, 16)) for x in hexes.split())


@pytest.mark.parametrize("slug", D.FAMILIES)
def test_family(spark, slug):
    rows = [(i, text(h)) for i, (h, _) in enumerate(VECTORS[slug])] + [(-1, None)]
    got = {r["i"]: r["v"] for r in spark.createDataFrame(rows, "i int, t string").select("i", D.FAMILIES[slug]("t").alias("v")).collect()}
    assert got[-1] is None
    assert [got[i]["sub_threat"] for i in range(len(VECTORS[slug]))] == [s for _, s in VECTORS[slug]]
    assert all((v["kind"] == "clear") == (v["sub_threat"] is None) for i, v in got.items() if i >= 0)


def test_positions(spark):
    rows = [("tag-block-payload", "a\U000e0041b\U000e0042", [1, 3]), ("rtl-injection", "\U0001f600aאבגד", [2]), ("renderer-divergence", "\U0001f600a" + "́" * 5, [1]), ("filename-disguise", "a.b.c.d", [1, 3, 5]),
            ("confusable-bidi-compound", "z‮а", [2, 1]), ("skin-tone-variation-forgery", "x\U0001f44b\U0001f3fb\U0001f3fc", [2, 3]), ("stream-safe-violation", "ab" + "̀" * 31, [2])]
    for slug, t, want in rows:
        assert spark.createDataFrame([(t,)], "t string").select(D.FAMILIES[slug]("t")["positions"].alias("p")).first()["p"] == want, slug


def test_hash_contexts(spark):
    d = spark.createDataFrame([("a\nb", "utf-16", "a\nc", "a\nb")], "t string, e string, s string, w string")
    one = lambda **k: d.select(D.hash_input_stability("t", **k)["sub_threat"].alias("x")).first()["x"]
    assert one(encoding=F.col("e")) == "EncodingMismatch" and one(server=F.col("s")) == "WebhookSignatureDrift" and one(written=F.col("w")) is None
    assert {r: one(rule=r) for r in D.RFC_RULES} == {r: "SignedMessageRule" if r != "pgp4880TrailingWhitespace" and r != "rfc6376DkimRelaxed" else None for r in D.RFC_RULES}


def test_far_dot_above(spark):
    """The dot above an I is found behind any number of other marks, and the place is the dot's."""
    texts = ["ab I" + "\u0323" * n + "\u0307 c" for n in (0, 1, 30, 31, 500)] + ["\u0307 I\u0323\u0301\u0307", "x\u0323\u0307", "aI b", "\U0001f600\u0130"]
    want = [[n + 4] for n in (0, 1, 30, 31, 500)] + [[2], [], [1], [1]]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("v", D.locale_case_inversion("t"))
    got = {r["k"]: (r["v"]["sub_threat"], r["v"]["positions"]) for r in df.collect()}
    assert got == {k: ("TurkishCaseDivergence" if w else None, w) for k, w in enumerate(want)}


def test_padded_target(tmp_path):
    """Characters that leave only marks in a skeleton don't hide a target, however many there are."""
    double = "p\u0430ypal"
    for pad in ("\u0f73", "\u0f75", "\u0f81", "\u200b\u0f73\u0301"):
        assert D.homoglyph_of(double + pad * 200)["sub_threat"] == "TargetMatch"
    assert D.homoglyph_of(double + "x" * 200)["sub_threat"] != "TargetMatch"
    (tmp_path / "confusables.txt").write_text("2E31 ;\t0301 ;\tMA\n0430 ;\t0061 ;\tMA\n")
    D.ucd.use_data_dir(str(tmp_path))
    try:
        assert D.homoglyph_of(double + "\u2e31" * 200)["sub_threat"] == "TargetMatch"
    finally:
        D.ucd.use_data_dir(None)
    

def test_shared_marks_are_of_no_script(spark):
    """An acute's Script_Extensions name Cyrillic and Greek, but it is Inherited: with a Latin base it mixes nothing."""
    d = spark.createDataFrame([("e" + "́" * 35,), ("éе",)], "t string").select(D.mixed_script_admissibility("t").alias("v")).select("v.sub_threat", "v.positions")
    assert [tuple(r) for r in d.collect()] == [(None, []), ("LatinCyrillic", [2])]
