"""Readers and writers of scan records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id string, text string, bytes array<int>, profile string, mode string, encoding string"
FIELDS = ("id", "text", "bytes", "profile", "mode", "encoding")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One message for each file: path, data (bytes)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def parse_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines as records, with `error` where a line isn't one: not an object, unknown fields, not
    exactly one of text and bytes, or bytes outside 0..255. A good record's payload is in `data`."""
    d = lines.withColumn("__r", F.from_json(line, RECORD, {"mode": "PERMISSIVE"}))
    keys = F.json_object_keys(line)
    r = F.col("__r")
    both = (r["text"].isNotNull()).cast("int") + (r["bytes"].isNotNull()).cast("int")
    error = (
        F.when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0, "unknown field")
        .when(F.size(keys) != F.size(F.array_distinct(keys)), "repeated field")
        .when(both != 1, "needs exactly one of text and bytes")
        .when(F.exists(r["bytes"], lambda b: b.isNull() | (b < 0) | (b > 255)), "byte out of range")
    )
    packed = F.unhex(F.array_join(F.transform(r["bytes"], lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    d = d.select(*lines.columns, *[r[f].alias(f) for f in FIELDS if f != "bytes"], F.coalesce(F.encode(r["text"], "UTF-8"), packed).alias("data"), error.alias("error"))
    return d


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(spark.read.text(path))


def to_wire(v: Column) -> Column:
    """A verdict as one JSON line, keys in a fixed order and nulls written."""
    return F.to_json(v, {"ignoreNullFields": "false"})


def write_verdicts(df: DataFrame, path: str, v: str = "verdict") -> None:
    df.select(to_wire(F.col(v)).alias("value")).write.text(path)


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Fixture text: `code points; class; positions; attributes; # name`, under @section and @level lines,
    which hold until the next of their kind. A file is read whole, so lines keep their order."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    from pyspark.sql import Window as W

    upto = W.orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    tag = lambda k: F.last(F.when(F.col("value").startswith(f"# @{k}"), F.trim(F.regexp_extract("value", rf"^# @{k}[ :]*(.*)$", 1))), True).over(upto)
    d = lines.withColumn("section", tag("section")).withColumn("level", tag("level")).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    part = lambda i: F.trim(F.split_part("value", F.lit(";"), F.lit(i)))
    body = F.split_part("value", F.lit("#"), F.lit(1))
    return d.select(
        "line", "section", "level",
        F.transform(F.filter(F.split(part(1), r"\s+"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int")).alias("input"),
        F.split_part(part(2), F.lit(":"), F.lit(1)).alias("kind"), F.nullif(F.split_part(part(2), F.lit(":"), F.lit(2)), F.lit("")).alias("sub_threat"),
        F.transform(F.filter(F.split(part(3), r"[,\s]+"), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int")).alias("positions"),
        F.map_from_entries(F.transform(F.regexp_extract_all(body, F.lit(r"(\w+)=([^;]*)"), F.lit(0)), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)), F.trim(F.split_part(x, F.lit("="), F.lit(2)))))).alias("attribution"),
        F.trim(F.regexp_extract("value", r"#\s*(.*)$", 1)).alias("name"),
    )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of each file, hashed where it is read."""
    return whole_files(spark, path).select("path", F.sha2("data", 256).alias("sha256"))


def attest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, status of each file of a manifest (name, sha256) and of each file beside it: `ok`, `changed`,
    `missing` or `unlisted`. files: digests()."""
    have = files.select(F.substring_index("path", "/", -1).alias("name"), F.col("sha256").alias("found"))
    d = manifest.join(have, "name", "full_outer")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("sha256") == F.col("found"), "ok").otherwise("changed")
    return d.select("name", status.alias("status"))
