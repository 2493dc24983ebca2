"""Text functions, policy, sources, set-level forms and streams."""

import json
import re
import tracemalloc
import unicodedata as ud

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from glyphloom import plans, sources, streaming
from glyphloom.functions import bidi, idna, registry, segment, ucd
from glyphloom.functions import text as T
from glyphloom.operators import policy as P


def one(spark, f, *values, schema="t string"):
    return spark.createDataFrame([values], schema).select(f(*[F.col(c.split()[0]) for c in schema.split(", ")]).alias("x")).first()["x"]


@pytest.mark.parametrize("f,value,want", [
    (lambda t: T.normalize(t, "NFC"), "e\u0301", "\u00e9"), (lambda t: T.normalize(t, "NFKD"), "ﬁ", "fi"), (T.is_normalized, "e\u0301", False), (T.fold_case, "Straße", "strasse"), (T.to_upper, "ﬁß", "FISS"),
    (lambda t: T.to_lower(t, "tr"), "Iİ", "ıi"), (T.to_lower, "ΑΣ", "ας"), (T.to_title, "hello wORLD", "Hello World"), (T.code_points, "a\U0001f600", [97, 128512]), (T.graphemes, "é\r\n\U0001f468‍\U0001f4bb", ["é", "\r\n", "\U0001f468‍\U0001f4bb"]),
    (T.grapheme_count, "a\r\nb", 3), (T.words, "can't stop", ["can't", " ", "stop"]), (segment.sentences, "One. Two? three", ["One. ", "Two? ", "three"]), (T.display_width, "a漢é", 4), (T.restriction_level, "abc", "ASCIIOnly"), (T.restriction_level, "aж", "MinimallyRestrictive"),
    (T.restriction_level, "漢かな", "HighlyRestrictive"), (T.is_identifier, "a1", True), (T.is_identifier, "1a", False), (T.has_mixed_numbers, "1٢", True), (T.is_stream_safe, "a" + "́" * 31, False), (T.punycode_encode, "bücher", "bcher-kva"), (T.punycode_decode, "bcher-kva", "bücher"),
    (T.skeleton, "раураl", T.skeleton_of("paypal")), (T.settled_skeleton, "m", "rn"), (T.script_union, "aж1", ["Cyrl", "Latn"]), (T.nonstarter_runs, "a\u0301b", [(1, 1)]),
])
def test_functions(spark, f, value, want):
    got = one(spark, f, value)
    assert ([tuple(x) for x in got] if want and isinstance(want, list) and isinstance(want[0], tuple) else got) == want
    assert one(spark, f, None) is None


def test_stream_safe_text(spark):
    fixed = one(spark, T.to_stream_safe, "a" + "́" * 40)
    assert one(spark, T.is_stream_safe, fixed) and fixed.replace("͏", "") == "a" + "́" * 40


def test_bytes(spark):
    b = lambda f, v: one(spark, f, bytearray(v), schema="t binary")
    assert b(T.utf8_error, b"ok") is None and tuple(b(T.utf8_error, b"a\xe0\x80\x80")) == (1, "Overlong")
    assert tuple(b(T.bom, b"\xff\xfe\0\0")) == ("UTF-32LE", 4) and bytes(b(T.strip_bom, b"\xef\xbb\xbfa")) == b"a"
    for enc, name in (("UTF-32LE", "utf-32-le"), ("UTF-32BE", "utf-32-be"), ("UTF-16LE", "utf-16-le")):
        assert bytes(one(spark, lambda t, e=enc: T.encode_text(t, e), "a\U0001f600")) == "a\U0001f600".encode(name)
    assert one(spark, lambda t: T.from_code_points(T.code_points(t)), "a\U0001f600é") == "a\U0001f600é"


def test_hangul(spark):
    d = spark.range(1)
    assert d.select(T.decompose_hangul(F.lit(0xD55C)).alias("x")).first()["x"] == [0x1112, 0x1161, 0x11AB]
    assert d.select(T.compose_hangul(F.lit(0x1112), F.lit(0x1161)).alias("x")).first()["x"] == 0xD558


def test_idna(spark):
    got = one(spark, idna.idna, "Bücher。example")
    assert got["ascii"] == "xn--bcher-kva.example" and got["unicode"] == "bücher.example" and got["errors"] == []
    assert one(spark, idna.idna, "-a.b")["errors"] == ["hyphen-edge"] and "bidi" in one(spark, idna.idna, "אa.com")["errors"]


def test_data_dir(tmp_path):
    (tmp_path / "confusables.txt").write_text("0430 ; 0061 ; MA # x\n")
    ucd.use_data_dir(str(tmp_path))
    try:
        assert ucd.confusables() == {"а": "a"}
    finally:
        ucd.use_data_dir(None)
    assert len(ucd.confusables()) > 1


def test_scan_and_modes(spark):
    d = spark.createDataFrame([(0, "fine"), (1, "a‮b"), (2, "a​b")], "id int, t string")
    act = lambda **k: [r["a"] for r in P.scan(d, "t", **k).select("id", F.col("verdict.action").alias("a")).orderBy("id").collect()]
    assert act() == ["allow", "quarantine", "allow"] and act(profile="url") == ["allow", "reject", "reject"]
    assert act(mode="observe") == ["allow", "observe", "observe"] and act(mode="strict") == ["allow", "reject", "reject"]
    v = P.scan(d, "t").where("id = 1").first()["verdict"]
    assert v["findings"][0]["code"] == "unicode.security.C.bidi-control-balance.UnbalancedEmbedding" and v["findings"][0]["positions"] == [1]
    assert P.family_results(d, "t").select(F.size("results").alias("n")).first()["n"] == 27
    assert [r["id"] for r in d.where(P.admissible_at("t", "minimal")).collect()] == [0, 2]
    assert set(P.LEVELS["minimal"]) < set(P.LEVELS["moderate"]) < set(P.LEVELS["restrictive"]) and [len(P.LEVELS[k]) for k in ("restrictive", "moderate", "minimal")] == [23, 19, 3]


def test_scan_bytes(spark):
    rows = [(0, bytearray(b"ok"), "UTF-8"), (1, bytearray(b"\xc3("), "UTF-8"), (2, bytearray("a‮".encode("utf-16-le")), "UTF-16LE"), (3, bytearray(b"\xff\xfea\0"), "bom"), (4, bytearray(b"\xef\xbb\xbf\xff"), "bom")]
    d = spark.createDataFrame(rows, "id int, d binary, e string")
    got = {r["id"]: r["verdict"] for r in P.scan_bytes(d, "d", F.col("e"), "url").collect()}
    assert [got[i]["action"] for i in range(5)] == ["allow", "reject", "reject", "allow", "reject"]
    assert got[1]["findings"][0]["code"] == "unicode.security.C.malformed-utf-8.InvalidContinuation" and got[4]["findings"][0]["positions"] == [3]


def test_composites_and_metrics(spark):
    d = P.scan(spark.createDataFrame([("a", "x‮"), ("a", "ok"), ("b", "ok")], "g string, t string"), "t")
    got = {r["g"]: r for r in P.compose(d, ["g"]).collect()}
    assert got["a"]["action"] == "quarantine" and got["a"]["severity"] == 2 and got["b"]["action"] == "allow" and got["b"]["reasons"] == []
    m = {(r["metric"], r["name"]): r["count"] for r in P.metrics(d).collect()}
    assert m["action", "allow"] == 2 and m["code", "unicode.security.C.bidi-control-balance.UnbalancedEmbedding"] == 1


def test_spans(spark):
    got = one(spark, lambda t: P.spans(t, F.array(F.lit(0), F.lit(3))), "é\na\U0001f600")
    assert [tuple(x) for x in got] == [(0, 0, 2, 1, 1), (3, 4, 8, 2, 2)]


def test_records_and_stream(spark, tmp_path):
    lines = ['{"id": "1", "text": "a\\u202e"}', '{"id": "2", "bytes": [104, 105]}', '{"text": "a", "bytes": [1]}', '{"text": "a", "other": 1}', "nonsense", '{"bytes": [300]}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    got = sources.read_records(spark, f"{tmp_path}/in").collect()
    assert [r["error"] is None for r in got] == [True, True, False, False, False, False] and bytes(got[1]["data"]) == b"hi"
    good = streaming.record_stream(spark, f"{tmp_path}/in").where("error IS NULL").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    scanned = streaming.scan_stream(good)
    q = scanned.select("id", sources.to_wire(F.col("verdict")).alias("v")).writeStream.format("memory").queryName("scanned").trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = {r["id"]: json.loads(r["v"] or "null") for r in spark.sql("SELECT * FROM scanned").collect()}
    assert rows["1"]["action"] == "quarantine" and rows["1"]["findings"][0]["sub_threat"] == "UnbalancedEmbedding"
    q = streaming.windowed_metrics(scanned, "ts").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["code"]: r["count"] for r in spark.sql("SELECT code, count FROM counted").collect()}["unicode.security.C.bidi-control-balance.UnbalancedEmbedding"] == 1


def test_fixture_text(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_text("# @section one\n# @level minimal\n0041 202E; Hazard:RloFlip; 1; a=1;b=x y; # name of it\n\n# @section two\n0042; Clear; ; ; # plain\n")
    rows = sources.read_fixture(spark, str(p)).orderBy("line").collect()
    assert [(r["section"], r["input"], r["kind"], r["sub_threat"], r["positions"], r["name"]) for r in rows] == [("one", [0x41, 0x202E], "Hazard", "RloFlip", [1], "name of it"), ("two", [0x42], "Clear", None, [], "plain")]
    assert rows[0]["attribution"] == {"a": "1", "b": "x y"} and rows[1]["level"] == "minimal"


def test_sets(spark):
    names = spark.createDataFrame([(1, "paypal"), (2, "раураl"), (3, "other")], "id long, name string")
    assert {(r["id"], r["impersonates"]) for r in plans.impostors(names.withColumnRenamed("name", "t"), "t", plans.protected_names(spark)).collect()} == {(2, "paypal")}
    assert {r["id"]: r["representative"] for r in plans.confusable_pairs(names, "id", "name").collect()} == {1: 1, 2: 1}
    lists = spark.createDataFrame([("en", "able"), ("fr", "able"), ("fr", "ami"), ("en", "zoo")], "lang string, word string")
    m = plans.mnemonics(spark.createDataFrame([(1, "able ami"), (2, "able no"), (3, "zoo ami"), (4, "")], "id long, s string"), "id", "s", lists)
    assert {r["id"]: r["verdict"]["sub_threat"] for r in m.collect()} == {1: None, 2: "WordlistMismatch", 3: "LanguageAmbiguous", 4: None}
    n = plans.characters_with(spark.createDataFrame([(1, "aж")], "id long, t string"), "id", "t", plans.property_ranges(spark, ["sc=Latin", "sc=Cyrillic"]))
    assert {(r["prop"], r["n"]) for r in n.collect()} == {("sc=Latin", 1), ("sc=Cyrillic", 1)}
    plans.register(spark)
    assert spark.sql("SELECT nfc('é') AS x, restriction_level('a') AS y").first() == ("é", "ASCIIOnly")
    twice = plans.scan_distinct(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, t string"), "t")
    assert {r["id"]: r["verdict"] and r["verdict"]["action"] for r in twice.collect()} == {1: "allow", 2: "allow", 3: None}


def test_manifest(spark, tmp_path):
    import hashlib

    for n in ("a", "b", "x"):
        (tmp_path / n).write_text(n)
    listed = spark.createDataFrame([("a", hashlib.sha256(b"a").hexdigest()), ("b", "0"), ("c", "0")], "name string, sha256 string")
    got = {r["name"]: r["status"] for r in sources.attest(sources.digests(spark, str(tmp_path)), listed).collect()}
    assert got == {"a": "ok", "b": "changed", "c": "missing", "x": "unlisted"}


def test_level_without_scripts(spark):
    """Numbers and signs are of one script, whichever it is, as UTS #39 resolves them."""
    assert one(spark, T.restriction_level, "435952⌚") == one(spark, T.restriction_level, "€") == "SingleScript"
    assert one(spark, T.restriction_level, "1﷐") == "Unrestricted"


def test_few_values_are_held(spark):
    """A batch's texts and results are not all Python objects at once."""
    texts = pa.array([f"{i} " + "éa bc " * 5000 for i in range(100)] + [None, "x"])
    f = T.vectorised(lambda x: x.split(" "), "array<string>").func
    tracemalloc.start()
    out = f(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [x and x.split(" ") for x in texts.to_pylist()]
    assert peak < 25_000_000


def test_counts_without_arrays(spark):
    """Counts and widths, which skip the letters that stand by themselves, agree with the pieces counted one by one."""
    plain = [chr(x) for x in range(0x300) if re.match(T.PLAIN, chr(x))]
    assert all(regex.fullmatch(r"[\p{GCB=Other}--\p{Extended_Pictographic}]", x, regex.V1) and ud.east_asian_width(x) not in "FW" and ud.category(x) not in ("Cc", "Mn", "Me") for x in plain)
    odd = ["", "é", "éa", "aé\u0301b¡x", "né\u200d\U0001f468\u200d\U0001f4bbab", "7\ufe0f\u20e3é", "漢字éab", "é\r\nb", "\u0600aé¨ bc", "\U0001f1e9\U0001f1eaé\U0001f1e9", "©é®", "a\xadé b", "שלום é. Ab c? De", "\u202eab é", "क्षé"]
    d = spark.createDataFrame([(x,) for x in odd], "t string").select(
        "t", T.grapheme_count("t").alias("g"), T.graphemes("t").alias("gs"), T.display_width("t").alias("w"), T.display_width("t", 2).alias("w2"), T.word_count("t").alias("n"), F.size(T.words("t")).alias("ns"),
        segment.sentence_count("t").alias("s"), F.size(segment.sentences("t")).alias("ss"), bidi.visual("t").alias("v"), bidi.resolve("t")["visual"].alias("vs"),
    )
    for r in d.collect():
        width = lambda a: sum(2 if T._SHOWN.search(g) else max(T.character_width(x, a) for x in g) for g in r["gs"])  # noqa: B023, E731
        assert (r["g"], r["n"], r["s"], r["v"]) == (len(r["gs"]), r["ns"], r["ss"], r["vs"])
        assert (r["w"], r["w2"]) == (width(1), width(2))
