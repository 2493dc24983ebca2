"""Operator 1, language identification: one Kneser-Ney code point model for each language.

The language with the lowest length-normalised cross-entropy is chosen. Rejection is calibrated: a
slice of labelled rows outside the counts gives each language the cross-entropy that only a share
REJECT of its own texts exceed; a text over it is marked rejected, and its score halved.

The models are fitted on a bounded sample of labelled rows, about ROWS of each language at most for
counts and HELD for calibration, and CHARS code points, shared among the languages, for each of the
two (whole texts, the first always); every whole text is scored.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the first
language in order; with nothing to learn from, all is `und`; repeated rows are scored one by one;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, stored, table, text_chunks
from .kneser import Model, count_grams, kneser_ney, read_counts, sample, within

ORDER = 4
ROWS, HELD = 4000, 1000
CHARS = 64_000_000
REJECT = 0.005
#: Cross-entropies compare as probabilities at this many nats a code point.
SHARPNESS = 20.0
UNKNOWN = "und"


def fit(df: DataFrame, text: Column, lang: Column, order: int = ORDER, rows: int = ROWS, held: int = HELD, chars: int = CHARS) -> tuple[Model | None, np.ndarray]:
    """The model of labelled rows, and each language's rejection bound."""
    d = sample(df.select(text.alias("text"), lang.alias("__lang")), F.col("__lang"), rows, held)
    d = stored(d.select("cls", "slice", "text"), "language-sample")
    classes = sorted(r[0] for r in d.select("cls").distinct().collect())  # the languages
    d = within(d, "text", chars // max(1, len(classes)))
    counts = count_grams(d.where("slice = 0"), order)
    if not classes:
        return None, np.empty(0)
    model = kneser_ney(read_counts(counts, order, classes), classes, order)
    bound = np.full(len(classes), np.inf)
    own = score(d.where("slice = 1"), ["cls"], "text", model, bound).where("lang_pred = cls")
    for r in own.groupBy("cls").agg(F.percentile_approx("cross_entropy", 1 - REJECT, 10000).alias("b")).collect():
        bound[classes.index(r["cls"])] = r["b"]
    return model, bound


def score(df: DataFrame, keep: list[str], text: str, model: Model, bound: np.ndarray) -> DataFrame:
    """keep, lang_pred, score, cross_entropy (nats a code point, of the chosen language), margin (to
    the next one), rejected."""
    d = df.select(*keep, F.col(text).alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast((model, bound))
    names = [*keep, "lang_pred", "score", "cross_entropy", "margin", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, limit = shared.value
        classes = pa.array([*m.classes, UNKNOWN])
        for batch in batches:
            letter = pc.fill_null(pc.match_substring_regex(batch.column(len(keep)), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offsets in text_chunks(batch, "__text"):
                total, size = m.text_sums(raw, offsets)
                cost = -total / np.maximum(size, 1)[:, None]
                best = cost.argmin(1)
                least = cost[np.arange(len(best)), best]
                odds = np.exp(-SHARPNESS * (cost - least[:, None])).sum(1)
                rest = np.where(np.arange(cost.shape[1]) == best[:, None], np.inf, cost).min(1)
                known, out = letter[lo:hi], least > limit[best]
                cols = [
                    classes.take(pa.array(np.where(known, best, len(m.classes)))), pa.array(np.where(known, np.where(out, 0.5, 1.0) / odds, 0.0)),
                    pa.array(least, mask=~known), pa.array(rest - least, mask=~known | ~np.isfinite(rest)), pa.array(known & out),
                ]
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]], *cols], names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{kept}, lang_pred string, score double, cross_entropy double, margin double, rejected boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_bucket(F.col("doc_id"), 4) == 2
    model, bound = fit(docs.where(~held), F.col("text"), F.col("lang"))
    d = docs.select("doc_id", held.alias("held_out"), "text")
    if model is None:
        return d.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return score(d, ["doc_id", "held_out"], "text", model, bound)
