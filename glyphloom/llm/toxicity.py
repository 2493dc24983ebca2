"""Operator 2, toxicity: class-conditional Kneser-Ney models of the words of toxic and ordinary text.

Both classes count n-grams of code points inside words at the highest order, and back off to one
Kneser-Ney model of all their counts: what a class has seen `cut` times or less is worth what the
shared counts say, so rare expressions speak for neither class. A toxic document is taken to be
ordinary words with a share SPOTS of words from the toxic model, as insults are few among many plain
words; its log-likelihood less that of an ordinary document, divided by the number of words, is the
text's evidence. (Without the mixture, small shifts between classes, such as their shares of
languages, add up over a long text and drown a handful of insults.) A logistic curve over the
evidence's logarithm gives the score; it and the choice of `cut` come from labelled rows outside
the counts.

Fitting takes a bounded sample of labelled rows, about ROWS of each class at most for counts and HELD
for the curve, CHARS code points of each (whole texts, the first always); every whole text is scored.

Defined cases: a null or empty text has evidence 0; labels other than 0 and 1 and null ones teach
nothing, and without rows of both classes all scores are 0; different labels of one id all count, equal ones once;
repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, stored, table, text_chunks
from .kneser import Model, count_words, read_words, sample, shared_counts, with_cut, within, word_sequences

ORDER = 8
ROWS, HELD = 3000, 1000
CHARS = 16_000_000
CUTS = (0.75, 3.0)
SPOTS = 0.002
#: What is added to evidence before its logarithm is taken.
FLOOR = 1e-4
_POWER = np.uint64(0x9E3779B97F4A7C15)


def word_evidence(model: Model, raw: np.ndarray, offsets: np.ndarray, spots: float = SPOTS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's evidence and number of words. Equal words are scored once."""
    cps, places, size = model.sequences(raw, offsets, len(model.grams))
    total, words = np.zeros(len(size)), np.zeros(len(size), np.int64)
    if not len(places):
        return total, words
    start = np.flatnonzero(np.diff(places, prepend=-9) > 1)
    length = np.diff(np.append(start, len(places)))
    power = np.cumprod(np.full(int(length.max()), _POWER))
    inside = np.arange(len(places)) - np.repeat(start, length)
    name = np.add.reduceat((cps[places].astype(np.uint64) + np.uint64(1)) * power[inside], start)
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    chosen = np.zeros(len(start), bool)
    chosen[first] = True
    order = np.empty(len(first), np.int64)
    order[np.argsort(first, kind="stable")] = np.arange(len(first))
    lp = model.log_probabilities(cps, places[np.repeat(chosen, length)])
    size_of = length[chosen]
    each = np.add.reduceat(lp[:, 1] - lp[:, 0], np.cumsum(size_of) - size_of, dtype=np.float64)
    each = np.log1p(spots * np.expm1(np.minimum(each, 50.0)))[order][which]
    row = np.repeat(np.arange(len(size)), size)[start]
    words = np.bincount(row, minlength=len(size))
    return np.bincount(row, each, len(size)) / np.maximum(words, 1), words


def evidence(df: DataFrame, keep: list[str], text: str, model: Model) -> DataFrame:
    """keep, evidence (nats a word in favour of the second class), words."""
    return _evidence(df, keep, text, df.sparkSession.sparkContext.broadcast(model))


def _evidence(df: DataFrame, keep: list[str], text: str, shared: Broadcast) -> DataFrame:
    d = df.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, raw, offsets in text_chunks(batch, "__text"):
                each, words = word_evidence(m, raw, offsets)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]], pa.array(each), pa.array(words)], [*keep, "evidence", "words"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{kept}, evidence double, words long")


def curve(x: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Logistic slope and intercept by Newton's method, lightly ridged."""
    scale = x.std() or 1.0
    a, w = np.stack((x / scale, np.ones(len(x))), 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 1e-2 * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return np.array([w[0] / scale, w[1]])


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, rows: int = ROWS, held: int = HELD, chars: int = CHARS) -> tuple[Model, np.ndarray] | None:
    """Model and logistic curve of labelled rows; None without rows of both classes. docs: key, text;
    labels: key, label. A sample of different labels, small enough to broadcast, is taken first, then one of
    the rows that have them, as an id may have many."""
    chosen = stored(sample(labels.where("label IN (0, 1)").select("key", "label").distinct(), F.col("label"), rows + held).select("key", "label"), "toxicity-labels")
    d = sample(docs.join(F.broadcast(chosen), "key"), F.col("label"), rows, held)
    d = within(stored(d.select("cls", "slice", "text"), "toxicity-sample"), "text", chars)
    classes = ["0", "1"]
    parts = shared_counts(read_words(count_words(d.where("slice = 0")), order, classes), order, word_sequences)
    if parts is None:
        return None
    best = None
    for cut in CUTS:
        shared = docs.sparkSession.sparkContext.broadcast(with_cut(parts, classes, cut))
        rest = _evidence(d.where("slice = 1"), ["cls"], "text", shared).select("cls", "evidence").toPandas()  # 2 * held rows at most
        shared.destroy()
        y = (rest["cls"] == "1").to_numpy().astype(float)
        if not 0 < y.sum() < len(y):
            return None
        x = np.log(np.maximum(rest["evidence"].to_numpy(), 0) + FLOOR)
        w = curve(x, y)
        p = np.clip(1 / (1 + np.exp(-(x * w[0] + w[1]))), 1e-9, 1 - 1e-9)
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        if best is None or loss < best[0]:
            best = loss, cut, np.array([max(w[0], 0.0), w[1]])
    return with_cut(parts, classes, best[1]), best[2]


def probability(given: Column, w: np.ndarray) -> Column:
    return 1 / (1 + F.exp(-(F.log(F.greatest(given, F.lit(0.0)) + FLOOR) * float(w[0]) + float(w[1]))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_bucket(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").alias("label")).where(crc_bucket(F.col("key"), 5) != 0)
    fitted = fit(docs.select(F.col("doc_id").alias("key"), "text"), labels)
    d = docs.select("doc_id", held.alias("held_out"), "text")
    if fitted is None:
        return d.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model, w = fitted
    d = evidence(d, ["doc_id", "held_out"], "text", model).withColumn("score", probability(F.col("evidence"), w))
    return d.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
