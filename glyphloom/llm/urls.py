r"""Operator 10, URL filters: a sort-merge range join of hosts with nested rules.

A host is turned into a canonical key, its labels reversed and each followed by a dot
(`a.example.net` -> `net.example.a.`), so that a rule's host and all its subdomains are one
interval of keys: [`net.example.`, `net.example/`), `/` being the character after `.`.
Intervals of that kind either nest or are disjoint. The distinct hosts and the rules' interval
starts are dealt by key range and sorted; a sweep over them keeps a stack with one slot per
label depth, holding the rule that started last there. A slot is active while the key is
below the end of its interval. What a range leaves on its stack is carried to the next ranges.

Only distinct hosts take part in the sweep, so a hot host costs one row there; hosts with
active rules are joined back to the urls. Everything is DataFrame operations.

Defined cases: a null url, or one without `://`, has an empty host and path and no rule; of several
fitting rules the longest (characters of host and path) wins, then the longer host, then `block`;
repeated rows are judged one by one; extra columns are ignored; no rules: all allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import literal_rows, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The production rules: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Of the rows of hosts (host: distinct, not null), those inside a rule's interval: host and
    `stack`, the array of rules (rule, verdict, host_length, path) active there.
    rules: rule, verdict, host, path."""
    item = F.struct("rule", "verdict", F.char_length("host").alias("host_length"), "path")
    starts = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy(host_key(F.col("host")).alias("key"))
        .agg(F.sort_array(F.collect_set(item)).alias("items"))
        .withColumn("depth", F.size(F.split("key", r"\.")) - 1)
    )
    depths = sorted(r[0] for r in starts.select("depth").distinct().collect())  # at most 127: a DNS name has no more labels
    if not depths:
        return hosts.where("false").select("host", F.expr("CAST(array() AS ARRAY<STRUCT<rule: STRING, verdict: STRING, host_length: INT, path: STRING>>)").alias("stack"))
    # a slot: [start, end) and the rules that start there
    slot = F.struct(F.col("key").alias("start"), F.expr("concat(substring(key, 1, char_length(key) - 1), '/')").alias("end"), "items")
    both = starts.select("key", F.lit(0).alias("is_host"), F.lit(None).cast("string").alias("host"), *[F.when(F.col("depth") == d, slot).alias(f"s{d}") for d in depths])
    none = both.schema
    both = both.unionByName(hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("is_host"), "host", *[F.lit(None).cast(none[f"s{d}"].dataType).alias(f"s{d}") for d in depths]))
    # dealt by key range; the block is stored with the row, so that it stays what it was
    blocks = stored(both.repartitionByRange("key", "is_host").withColumn("block", F.spark_partition_id()), "url-blocks")
    # what each block leaves on the stack, then what it finds there: a few rows per block
    left = blocks.where("is_host = 0").groupBy("block").agg(*[F.max(f"s{d}").alias(f"s{d}") for d in depths])
    found = blocks.select("block").distinct().join(left, "block", "left")
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    found = found.select("block", *[F.last(f"s{d}", True).over(before).alias(f"c{d}") for d in depths])
    sweep = W.partitionBy("block").orderBy("key", "is_host").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = blocks.select("block", "key", "is_host", "host", *[F.last(f"s{d}", True).over(sweep).alias(f"s{d}") for d in depths]).where("is_host = 1").join(found, "block")
    active = []
    for d in depths:
        top = F.coalesce(F.col(f"s{d}"), F.col(f"c{d}"))
        active.append(F.when((top["start"] <= F.col("key")) & (F.col("key") < top["end"]), top["items"]).otherwise(F.array().cast(none[f"s{d}"].dataType["items"].dataType)))
    return swept.select("host", F.concat(*active).alias("stack")).where(F.size("stack") > 0)


def judge(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict for every row of df."""
    d = df.select(F.col(id_col).alias("__id"), F.col(url).alias("__url"))
    host, path = split_url(F.col("__url"))
    d = d.select("__id", host.alias("__host"), path.alias("__path"))
    hosts = d.select(F.col("__host").alias("host")).distinct()
    stacks = stored(host_stacks(hosts, rules), "url-stacks")
    d = d.join(stacks.withColumnRenamed("host", "__h"), F.col("__host") == F.col("__h"), "left")
    best = F.expr(
        "array_max(transform(filter(stack, r -> startswith(__path, r.path)), r -> "
        "named_struct('n', r.host_length + char_length(r.path), 'h', r.host_length, 'b', r.verdict = 'block', 'rule', r.rule, 'verdict', r.verdict)))"
    )
    d = d.withColumn("__best", best)
    return d.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return literal_rows(spark, ["rule", "verdict", "host", "path"], [(h + p, v, h, p) for v, h, p in rules])


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC, verdict DESC) AS k
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND k = 1
"""
