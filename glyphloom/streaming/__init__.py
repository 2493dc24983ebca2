"""Scans and their metrics over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policy import scan
from ..sources import parse_records


def record_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON line records of a folder as they arrive, parsed and checked."""
    return parse_records(spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path))


def scan_stream(stream: DataFrame, text: str = "text", profile: str = "chat-message", mode: str = "enforce") -> DataFrame:
    """Stateless: each record gets its verdict."""
    return scan(stream, text, profile, mode)


def windowed_metrics(stream: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Reason code counts by event time window; late rows beyond the watermark are left out."""
    d = stream.withWatermark(time, late).select(time, F.explode_outer("verdict.findings.code").alias("code"))
    return d.groupBy(F.window(time, window).alias("window"), F.coalesce("code", F.lit("clear")).alias("code")).count()


def fresh_payloads(stream: DataFrame, payload: str, time: str, within: str = "1 hour") -> DataFrame:
    """Records whose payload hasn't been seen within the time, so that repeats aren't scanned again."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([payload])
