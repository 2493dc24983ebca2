"""What the corpus operators share: shared-folder tables and Arrow text chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex for the gaps between words; a word is a run of anything else.
GAP = "[\\x20\\x09-\\x0D]+"
#: Bytes of text that a Python kernel handles at a time.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only a local master, whose executors share the
    driver's disk, gets a folder of its own where none is set; a cluster without one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glyphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it."""
    files, at = _at(spark, path)
    files.delete(at, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the session's JVM ends."""
    files, at = _at(spark, path)
    files.deleteOnExit(at)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block go at its end: whatever is read from them must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later plans start there,
    and a lost executor loses none of it. The files go when the session's JVM ends, or before
    that with `superseded` or `scratch`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def superseded(df: DataFrame) -> None:
    """Delete a stored table that no later plan reads."""
    remove(df.sparkSession, df._stored_at)


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n (a null key counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def text_chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of a batch's rows of about limit bytes of text (a longer text is a run of its own):
    first row, row after the last, the run's UTF-8 bytes, and its n+1 byte offsets. Null texts are empty."""
    col = batch.column(batch.schema.get_field_index(text))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = col.fill_null("") if col.null_count else col
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in raw."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A few rows as literals in the plan."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """raw with a space after each text, and the texts' offsets there (ends without the space)."""
    n = len(offsets) - 1
    out = np.full(len(raw) + n, 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(raw)) + row] = raw
    return out, offsets + np.arange(n + 1)
