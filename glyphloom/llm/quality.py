"""Operator 8, quality rules: document rules, then host verdicts with an empirical beta prior.

All of it is Spark SQL expressions. Rule counts of a text are computed inside its row, so texts
are never shuffled; only (host, count, failures) is, after map-side aggregation.

Defined cases: a null or empty text has no words and fails; a null host is a host of its own;
repeated rows are judged one by one; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, stored, table

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A host goes when its shrunken failure rate is over this.
HOST_LIMIT = 0.5
#: Symbols above this share of word characters count as a failure for the host's rate.
SYMBOL_PERCENT = 10


def rule_counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns keep, and FEATURES of the text column.

    Windows of five words are compared by hash first; only a text in which two hashes agree
    has its windows compared as strings, so counts are exact and most texts take one pass."""
    d = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__t"))
    d = d.withColumn("__w", F.expr(f"array_remove(split(__t, r'{GAP}'), '')"))
    d = d.withColumn("__n", F.size("__w"))
    d = d.withColumn("__h", F.expr("CASE WHEN __n > 5 THEN transform(sequence(0, __n - 5), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2], __w[i + 3], __w[i + 4])) END"))
    d = d.withColumn("__s", F.expr("CASE WHEN __n > 5 AND size(array_distinct(__h)) < __n - 4 THEN sort_array(transform(sequence(0, __n - 5), i -> struct(array_join(slice(__w, i + 1, 5), ' ') AS g, i AS i))) END"))
    d = d.withColumn("__p", F.expr("CASE WHEN __s IS NOT NULL THEN sort_array(filter(transform(__s, (x, k) -> CASE WHEN (k > 0 AND __s[k - 1].g = x.g) OR (k < __n - 5 AND __s[k + 1].g = x.g) THEN x.i END), x -> x IS NOT NULL)) END"))
    return d.select(
        *[F.col(c) for c in keep],
        F.col("__n").cast("long").alias("n_words"),
        F.expr("CAST(char_length(array_join(__w, '')) AS BIGINT)").alias("word_chars"),
        F.expr("CAST(char_length(regexp_replace(__t, '[^#*$%&|<>]+', '')) AS BIGINT)").alias("n_symbols"),
        F.expr(r"CAST(aggregate(array(filter(split(__t, '\n'), x -> x RLIKE r'[^\x20\x09-\x0D]')), 0, (a, x) -> size(x) - size(array_distinct(x))) AS BIGINT)").alias("n_dup_lines"),
        F.expr("CAST(CASE WHEN size(__p) > 1 THEN 5 + aggregate(sequence(0, size(__p) - 2), 0, (a, k) -> a + least(5, __p[k + 1] - __p[k])) ELSE 0 END AS BIGINT)").alias("n_repeat_words"),
    )


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failed() -> F.Column:
    """A failure as the host's rate counts it."""
    return base_failed() | (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"))


def host_verdicts(docs: DataFrame, host: str, failed: F.Column, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: __host, docs, failures, rate (shrunken), host_rejected.

    The beta prior is fitted over all hosts by moments: the spread of host rates beyond binomial
    noise gives its strength. Only five sums reach the driver."""
    hosts = docs.groupBy(F.col(host).alias("__host")).agg(F.count(F.lit(1)).alias("docs"), F.sum(failed.cast("long")).alias("failures"))
    hosts = stored(hosts, "hosts")
    s = hosts.agg(
        F.count(F.lit(1)).alias("h"), F.sum("docs").alias("n"), F.sum("failures").alias("f"),
        F.sum(F.col("failures") * F.col("failures") / F.col("docs")).alias("q"),
    ).first()
    mean, strength = prior(s["h"], s["n"] or 0, s["f"] or 0, s["q"] or 0.0)
    rate = (F.col("failures") + mean * strength) / (F.col("docs") + strength)
    return hosts.withColumn("rate", rate).withColumn("host_rejected", F.col("rate") > limit)


def prior(hosts: int, docs: int, failures: int, squares: float) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the prior; squares is the sum of failures^2 / docs."""
    if not docs:
        return 0.0, 1.0
    m = failures / docs
    between = squares / docs - m * m - hosts * m * (1 - m) / docs
    return m, 1e6 if between <= 0 else min(1e6, max(1.0, m * (1 - m) / between - 1))


def quality(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """id, FEATURES, base_failed, kept; kept is false for base failures and for rejected hosts."""
    d = df.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"), F.col(host).alias("__src"))
    d = stored(rule_counts(d, "__text", ["__id", "__src"]), "rules")
    bad = host_verdicts(d, "__src", rule_failed()).where("host_rejected").select("__host", F.lit(True).alias("__bad"))
    d = d.join(bad, d["__src"].eqNullSafe(bad["__host"]), "left")
    return d.select(F.col("__id").alias(id_col), *FEATURES, base_failed().alias("base_failed"), (~base_failed() & F.col("__bad").isNull()).alias("kept"))


def filter_documents(df: DataFrame, text: str = "text", host: str = "source", broadcast_rows: int = 100_000) -> DataFrame:
    """The rows of df that the rules keep, with df's columns unchanged. The rejected hosts are
    broadcast only up to broadcast_rows of them; beyond that Spark joins by shuffle."""
    cols = df.columns
    rules = rule_counts(df.select(F.col(text).alias("__text"), F.col(host).alias("__src")), "__text", ["__src"])
    bad = host_verdicts(rules, "__src", rule_failed()).where("host_rejected").select("__host")
    n = bad.limit(broadcast_rows + 1).count()
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col(text).alias("__text"), F.col(host).alias("__src"))
    # a column that isn't deterministic keeps the filter above the counts: pushed below them, it would
    # take each text apart again for every word
    counted = rule_counts(marked, "__text", ["__row", "__src"]).withColumn("__fence", F.monotonically_increasing_id())
    kept = counted.where((F.col("__fence") >= 0) & ~base_failed()).select("__row", "__src")
    if n:
        kept = kept.join(F.broadcast(bad) if n <= broadcast_rows else bad, kept["__src"].eqNullSafe(bad["__host"]), "left_anti")
    return kept.select("__row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) > 4),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM v, (SELECT unnest(range(0, 5)) AS k) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, sum((base_failed OR 100 * n_symbols > 10 * word_chars)::BIGINT) AS f FROM b GROUP BY source),
s AS (SELECT count(*) AS h, sum(n) AS n, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q FROM h),
k AS (SELECT m, CASE WHEN q - m * m - h * m * (1 - m) / n <= 0 THEN 1e6
                     ELSE least(1e6, greatest(1.0, m * (1 - m) / (q - m * m - h * m * (1 - m) / n) - 1)) END AS z FROM s),
r AS (SELECT source, (f + m * z) / (n + z) > 0.5 AS rejected FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
