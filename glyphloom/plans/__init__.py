"""Set-level forms: joins, reports and scans over whole tables of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detectors as D
from ..operators import policy as P


def scan_distinct(df: DataFrame, text: str, **options) -> DataFrame:
    """scan(), each different text once: for tables with many repeats. Rows with null text get none."""
    seen = P.scan(df.select(F.col(text).alias("__k")).where("__k IS NOT NULL").distinct(), "__k", **options)
    return df.join(seen, df[text] == seen["__k"], "left").drop("__k")


def confusable_pairs(df: DataFrame, id_col: str, text: str, key: str = "skeleton") -> DataFrame:
    """Groups of different texts with one skeleton: skeleton, id, text, representative (least id).
    Members are listed with their group's representative instead of as all pairs."""
    f = {"skeleton": T.skeleton, "settled": T.settled_skeleton, "letters": T.letter_skeleton}[key]
    distinct = df.groupBy(F.col(text).alias("__t")).agg(F.min(id_col).alias("__id")).withColumn("skeleton", f("__t"))
    groups = distinct.groupBy("skeleton").agg(F.count(F.lit(1)).alias("texts"), F.min("__id").alias("representative")).where("texts > 1")
    return distinct.join(groups, "skeleton").select("skeleton", F.col("__id").alias(id_col), F.col("__t").alias(text), "representative", "texts")


def impostors(df: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """Rows whose letters are a protected name's (names: ordinal, name) without being it: df's columns
    and the first such name. names is a small dimension: its letters are joined by equality."""
    keyed = names.withColumn("__n", T.letter_skeleton("name"))
    d = df.withColumn("__l", T.letter_skeleton(text)).withColumn("__row", F.monotonically_increasing_id())
    hit = d.join(keyed, (F.col("__l") == F.col("__n")) & (F.col("name") != F.col(text)))
    first = hit.groupBy("__row").agg(F.min_by("name", "ordinal").alias("impersonates"), *[F.first(c).alias(c) for c in df.columns])
    return first.drop("__row")


def protected_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(D.TARGETS)), "ordinal int, name string")


def mnemonics(df: DataFrame, id_col: str, text: str, wordlists: DataFrame) -> DataFrame:
    """id, words, verdict of mnemonic sentences; wordlists: lang, word. Words meet the lists in a join and
    come back in order, so neither side needs to be small."""
    canonical = F.trim(F.regexp_replace(F.lower(T.normalize(F.col(text), "NFKD")), "[\\x{20}\\x{3000}]+", " "))
    d = df.select(F.col(id_col).alias("__id"), F.col(text).alias("__t"), F.filter(F.split(canonical, " "), lambda w: w != "").alias("__w"))
    lists = wordlists.groupBy("word").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    w = d.select("__id", F.posexplode("__w").alias("i", "word")).join(lists, "word", "left")
    known = w.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("langs", F.array().cast("array<string>")).alias("l")))).alias("k"))
    d = d.join(known, "__id", "left").withColumn("known", F.coalesce(F.col("k.l"), F.array().cast("array<array<string>>")))
    return d.select(F.col("__id").alias(id_col), F.size("__w").alias("words"), D.bip39_canonical("__t", F.col("known")).alias("verdict"))


def property_ranges(spark: SparkSession, props: list[str]) -> DataFrame:
    """prop, lo, hi: properties as a range dimension, for joins on code points."""
    from ..functions import ucd

    rows = [(p, lo, hi) for p in props for lo, hi in ucd.spans(sorted(ucd.members(p)))]
    return spark.createDataFrame(rows, "prop string, lo int, hi int")


def characters_with(df: DataFrame, id_col: str, text: str, ranges: DataFrame) -> DataFrame:
    """id, prop, n: how many characters of each text have each property. The ranges are cut at blocks of
    256 code points, so the range test is an equality join on the block with a residual."""
    blocks = ranges.select("prop", "lo", "hi", F.explode(F.sequence(F.expr("lo DIV 256"), F.expr("hi DIV 256"))).alias("block"))
    cps = df.select(F.col(id_col), F.explode(T.code_points(text)).alias("cp")).groupBy(id_col, "cp").count()
    hit = cps.withColumn("block", F.expr("cp DIV 256")).join(blocks, "block").where("cp BETWEEN lo AND hi")
    return hit.groupBy(id_col, "prop").agg(F.sum("count").alias("n"))


def worst(df: DataFrame, k: int, v: Column | None = None) -> DataFrame:
    """The k rows with most findings."""
    return df.orderBy(F.size(F.col("verdict.findings") if v is None else v).desc()).limit(k)


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two results has, with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def register(spark: SparkSession) -> None:
    """SQL functions: nfc, nfd, nfkc, nfkd, skeleton, letter_skeleton, casefold, restriction_level, line_count,
    sentence_count, domain_to_ascii."""
    import unicodedata as ud

    from ..functions import idna, segment

    def add(name: str, one, kind: str, *needs: str) -> None:
        spark.udf.register(name, T.vectorised(one, kind, *needs))

    for form in T.FORMS:
        add(form.lower(), (lambda f: lambda s: ud.normalize(f, s))(form), "string")
    add("skeleton", T.skeleton_of, "string", "confusables")
    add("letter_skeleton", T.letters_of, "string", "confusables")
    add("casefold", str.casefold, "string")
    add("restriction_level", T.level_of, "string", "identifier")
    add("line_count", lambda s: len(segment.line_breaks(s)), "int")
    add("sentence_count", lambda s: len(segment.sentence_breaks(s)), "int")
    add("domain_to_ascii", lambda s: idna.process(s)["ascii"], "string", "idna")
