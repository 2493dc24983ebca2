"""Interpolated Kneser-Ney models of code points for several classes, in sorted hash arrays.

An n-gram's key is a 64-bit linear hash of its code points. For each order the keys that any class
has seen are kept sorted, beside the log-probability that each class gives the n-gram, discounts
and lower orders included; contexts likewise with each class's backoff weight. A lookup finds a key
by its top bits and a short walk, and n-grams that no class has seen fall through to lower orders.

Counts are aggregated by Spark over a sample of labelled rows that is bounded in rows and in code
points; the finished model has at most as many n-grams as the sample has code points, a float for
each class, and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GAP, spaced, stored, text_chunks

#: Odd multipliers of a code point by its distance from the end, from a fixed seed.
MULTIPLIERS = np.random.default_rng(20240229).integers(1 << 62, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The code point before a text's first.
START = 0x110000
_LOWER = np.arange(START + 1, dtype=np.uint32)
_LOWER[:0x10000] = [ord(c) if len(c) == 1 else i for i, c in enumerate(map(str.lower, map(chr, range(0x10000))))]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of UTF-8 texts, and the texts' offsets in them."""
    cps = _LOWER[np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    return cps, np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]


def text_sequences(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with order - 1 start marks before each: code points, the places to score, and how
    many of them each text has."""
    cps, at = code_points(raw, offsets)
    size = np.diff(at)
    places = np.arange(len(cps)) + np.repeat(np.arange(1, len(size) + 1) * (order - 1), size)
    out = np.full(len(cps) + len(size) * (order - 1), START, np.uint32)
    out[places] = cps
    return out, places, size


def word_sequences(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like text_sequences, but each word is a sequence of its own, closed by a space."""
    cps, at = code_points(*spaced(raw, offsets))
    gap = (cps == 32) | ((cps >= 9) & (cps <= 13))
    before = np.concatenate(([True], gap[:-1]))
    keep = ~gap | ~before
    word = np.cumsum(~gap & before)[keep]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))[keep]
    places = np.arange(len(word)) + word * (order - 1)
    out = np.full(len(word) + (word[-1] if len(word) else 0) * (order - 1), START, np.uint32)
    out[places] = np.where(gap, 32, cps)[keep]
    return out, places, np.bincount(row, minlength=len(offsets) - 1)


def keys(cps: np.ndarray, places: np.ndarray, order: int, context: bool = False) -> np.ndarray:
    """Keys of the n-grams that end at the places (their contexts': without the last code point)."""
    total = np.zeros(len(places), np.uint64)
    for k in range(int(context), order):
        total += (cps[places - k].astype(np.uint64) + np.uint64(1)) * MULTIPLIERS[k]
    return total


class SortedKeys:
    """A sorted array of distinct keys with an index of their top bits, which each process makes for itself."""

    def __init__(self, values: np.ndarray):
        self.values, self.first = values, None
        self.shift = np.uint64(64 - max(1, min(22, int(np.ceil(np.log2(len(values) + 1))))))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"first": None}

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.values):
            return out
        if self.first is None:
            self.first = np.searchsorted(self.values, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        open_ = None
        while True:
            inside = at < len(self.values)
            here = self.values[np.minimum(at, len(self.values) - 1)]
            hit = inside & (here == wanted)
            out[hit if open_ is None else open_[hit]] = at[hit]
            more = np.flatnonzero(inside & (here < wanted))
            if not len(more):
                return out
            open_ = more if open_ is None else open_[more]
            at, wanted = at[more] + 1, wanted[more]


class Model:
    """classes; for each order from 1: (SortedKeys, log-probabilities by class), (SortedKeys, log backoff
    weights by class), or one column of them where all classes agree. sequences says how texts are cut."""

    def __init__(self, classes: list[str], grams: list, contexts: list, unseen: np.ndarray, sequences=text_sequences):
        self.classes, self.grams, self.contexts, self.unseen, self.sequences = classes, grams, contexts, unseen, sequences

    def log_probabilities(self, cps: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Each class's log-probability of the code point at each place."""
        out = np.zeros((len(places), len(self.classes)), np.float32)
        todo = np.arange(len(places))
        for n in range(len(self.grams), 0, -1):
            found, values = self.grams[n - 1]
            place = found.find(keys(cps, places[todo], n))
            hit = place >= 0
            out[todo[hit]] += values[place[hit]]
            todo = todo[~hit]
            if n > 1 and len(todo):
                found, values = self.contexts[n - 1]
                place = found.find(keys(cps, places[todo], n, True))
                hit = place >= 0
                out[todo[hit]] += values[place[hit]]
        out[todo] += self.unseen
        return out

    def text_sums(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, each class's total log-probability, and how many code points that is."""
        cps, places, size = self.sequences(raw, offsets, len(self.grams))
        total, some = np.zeros((len(size), len(self.classes))), np.flatnonzero(size)
        if len(some):
            lp = self.log_probabilities(cps, places)
            edges = (np.cumsum(size) - size)[some]
            for c in range(lp.shape[1]):
                total[some, c] = np.add.reduceat(lp[:, c], edges, dtype=np.float64)
        return total, size


def sample(df: DataFrame, label: Column, rows: int, held: int = 0) -> DataFrame:
    """df with `cls` (label as text, not null): about `rows` rows of each class at most, chosen by a hash of the
    row's place, so that equal keys and texts are chosen one by one; with held, a further `held` rows of each
    class as slice 1, the others being slice 0."""
    d = df.withColumn("cls", label.cast("string")).where("cls IS NOT NULL")
    u = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    counts = {r["cls"]: r["count"] for r in d.groupBy("cls").count().collect()}  # one row for each class
    if not counts:
        return d.where("false").withColumn("slice", F.lit(0))
    share = lambda n: F.element_at(F.create_map(*[x for c, k in counts.items() for x in (F.lit(c), F.lit(float(n(k))))]), F.col("cls"))
    part = held / (rows + held)
    a, b = share(lambda k: min(1.0 - part, rows / k)), share(lambda k: min(1.0, (rows + held) / k) if held else min(1.0, rows / k))
    return d.withColumn("__u", u).where(F.col("__u") < b).withColumn("slice", (F.col("__u") >= a).cast("int") if held else F.lit(0)).drop("__u")


def within(sampled: DataFrame, text: str, chars: int) -> DataFrame:
    """Rows of a stored sample (cls, slice, text) up to `chars` code points of each class and slice, whole texts
    in the order of a hash; the first of them always. Only lengths are sorted."""
    d = sampled.withColumn("__at", F.monotonically_increasing_id())
    w = W.partitionBy("cls", "slice").orderBy(F.xxhash64("__at"), "__at")
    upto = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    lengths = d.select("cls", "slice", "__at", F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n"))
    kept = lengths.withColumn("upto", upto).withColumn("first", F.row_number().over(w) == 1).where((F.col("upto") <= chars) | F.col("first")).select("__at")
    return stored(d.join(F.broadcast(kept), "__at", "left_semi").drop("__at"), "sample")


def count_grams(df: DataFrame, order: int, text: str = "text", sequences=text_sequences) -> DataFrame:
    """df: cls, text. Returns cls, gram (code points as 4-byte integers), n."""
    d = df.select("cls", F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            own = names.indices.to_numpy()
            for lo, hi, raw, offsets in text_chunks(batch, "__text"):
                cps, places, size = sequences(raw, offsets, order)
                if not len(places):
                    continue
                cls = np.repeat(own[lo:hi], size)
                k = keys(cps, places, order) + cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                _, at, n = np.unique(k, return_index=True, return_counts=True)
                grams = np.stack([cps[places[at] - order + 1 + i] for i in range(order)], 1).astype("<u4")
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * order), len(at), [None, pa.py_buffer(grams.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(cls[at])), flat, pa.array(n)], ["cls", "gram", "n"])

    return d.mapInArrow(run, "cls string, gram binary, n long").groupBy("cls", "gram").agg(F.sum("n").alias("n"))


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """df: cls, text. Returns cls, word, n."""
    d = df.select("cls", F.explode(F.split(F.col(text), GAP)).alias("word")).where("word <> ''")
    return d.groupBy("cls", "word").agg(F.count(F.lit(1)).alias("n"))


def read_words(counts: DataFrame, order: int, classes: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Like read_counts, for the n-grams inside words, from count_words' rows."""
    t, out = counts.toArrow().combine_chunks(), []
    for c in classes:
        own = t.filter(pc.equal(t["cls"], c))
        batch = pa.RecordBatch.from_arrays([own["word"].cast(pa.large_string()).combine_chunks()], ["word"])
        grams, number = [np.empty((0, order), np.uint32)], [np.empty(0, np.int64)]
        for lo, hi, raw, offsets in text_chunks(batch, "word"):
            cps, places, size = word_sequences(raw, offsets, order)
            weight = np.repeat(own["n"].to_numpy()[lo:hi], size)
            _, at, which = np.unique(keys(cps, places, order), return_index=True, return_inverse=True)
            grams.append(np.stack([cps[places[at] - order + 1 + i] for i in range(order)], 1))
            number.append(np.bincount(which, weight, len(at)).astype(np.int64))
        grams, number = np.concatenate(grams), np.concatenate(number)
        _, at, which = np.unique(_hash(grams), return_index=True, return_inverse=True)
        out.append((grams[at], np.bincount(which, number, len(at)).astype(np.int64)))
    del t, own, batch
    pa.default_memory_pool().release_unused()  # the driver builds the model next
    return out


def _discount(n: np.ndarray) -> float:
    once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
    return once / (once + 2 * twice) if once and twice else 0.75


def read_counts(counts: DataFrame, order: int, classes: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """count_grams' rows on the driver (as many as the sample has at most): for each class, distinct
    n-grams as rows of code points, and their counts."""
    t = counts.toArrow()
    names = np.asarray(t["cls"].to_pylist(), object)
    grams = np.frombuffer(b"".join(t["gram"].to_pylist()), "<u4").reshape(-1, order)
    number = t["n"].to_numpy()
    return [(grams[names == c], number[names == c]) for c in classes]


def kneser_ney(by_class: list[tuple[np.ndarray, np.ndarray]], classes: list[str], order: int, sequences=text_sequences) -> Model:
    """The model of each class's counts."""
    every = by_class[0][0] if len(by_class) == 1 else np.concatenate([g for g, _ in by_class]) if by_class else np.empty((0, order), np.uint32)
    symbols = len(np.unique(every[:, -1:])) + 1  # what can be predicted, and any other code point
    lower = np.full((1, len(classes)), 1.0 / symbols)  # order 0: any code point
    lower_keys = np.zeros(1, np.uint64)
    out_grams, out_contexts, unseen = [], [], np.full(len(classes), -np.log(symbols))
    for n in range(1, order + 1):
        part = every[:, order - n :]
        union, at = np.unique(_hash(part), return_index=True)
        suffix = _hash(part[at][:, 1:])
        contexts, where = np.unique(_hash(part[at], 1), return_inverse=True)
        own, discount = np.zeros((len(union), len(classes))), np.zeros(len(classes))
        for c, (grams, number) in enumerate(by_class):
            if n == order:
                k, value = _hash(grams), number.astype(np.float64)
            else:  # how many different code points come before
                _, first = np.unique(_hash(grams[:, order - n - 1 :]), return_index=True)
                k, value = np.unique(_hash(grams[first][:, order - n :]), return_counts=True)
            own[np.searchsorted(union, k), c] = value
            discount[c] = _discount(value)
        total, kinds = _sums(own, where, len(contexts)), _sums(own > 0, where, len(contexts))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(own - discount, 0) / np.maximum(total, 1)[where] + weight[where] * lower[np.searchsorted(lower_keys, suffix)]
        if n == 1 and len(weight):
            unseen = np.log(weight[0] / symbols)
        out_grams.append((SortedKeys(union), np.log(p).astype(np.float32)))
        out_contexts.append((SortedKeys(contexts), np.log(weight).astype(np.float32)))
        lower, lower_keys = p, union
    return Model(classes, out_grams, out_contexts, np.asarray(unseen, np.float32), sequences)


def shared_counts(by_class: list[tuple[np.ndarray, np.ndarray]], order: int, sequences=text_sequences) -> tuple[Model, np.ndarray, np.ndarray] | None:
    """What classes that back off to one model share, whatever the cut: the Kneser-Ney model of all their counts,
    the context of each of its longest n-grams, and each class's count of them. None if a class has none."""
    if not all(len(g) for g, _ in by_class):
        return None
    names = [_hash(g) for g, _ in by_class]
    k, at, inverse = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    total = np.bincount(inverse, np.concatenate([n for _, n in by_class]), len(k))
    del inverse
    own = np.zeros((len(k), len(by_class)), np.float32)  # exact: a sample has under 2 ** 24 code points
    for c, (name, (_, n)) in enumerate(zip(names, by_class, strict=True)):
        own[np.searchsorted(k, name), c] = n
    top = np.concatenate([g for g, _ in by_class])[at]
    del by_class, names, at, k
    base = kneser_ney([(top, total)], ["all"], order, sequences)
    return base, np.searchsorted(base.contexts[-1][0].values, _hash(top, 1)), own


def with_cut(shared: tuple[Model, np.ndarray, np.ndarray], classes: list[str], cut: float) -> Model:
    """Classes that back off to one Kneser-Ney model of all their counts: a class's probability is
    its own count less `cut`, over its context's count, and the mass so cut spread like that model.
    What a class has seen `cut` times or less thus weighs as much as all classes together say."""
    base, where, own = shared
    contexts = len(base.contexts[-1][0].values)
    total, lost = _sums(own, where, contexts), _sums(np.minimum(own, np.float32(cut)), where, contexts)
    weight = np.where(total > 0, lost / np.maximum(total, 1), 1.0)
    p = np.empty(own.shape, np.float32)
    lower = np.exp(base.grams[-1][1][:, 0].astype(np.float64))
    for c in range(own.shape[1]):
        p[:, c] = np.log(np.maximum(own[:, c] - cut, 0) / np.maximum(total[:, c], 1)[where] + weight[:, c][where] * lower)
    grams, ctx = list(base.grams), list(base.contexts)
    grams[-1] = (grams[-1][0], p)
    ctx[-1] = (ctx[-1][0], (np.log(weight) + ctx[-1][1]).astype(np.float32))
    return Model(classes, grams, ctx, np.repeat(base.unseen, len(classes)), base.sequences)


def _sums(values: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(where, values[:, c], n) for c in range(values.shape[1])], 1)


def _hash(grams: np.ndarray, skip: int = 0) -> np.ndarray:
    """Keys of rows of code points, without the last skip ones."""
    n = grams.shape[1]
    total = np.zeros(len(grams), np.uint64)
    for k in range(skip, n):
        total += (grams[:, n - 1 - k].astype(np.uint64) + np.uint64(1)) * MULTIPLIERS[k]
    return total
