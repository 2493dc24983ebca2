"""Operator 6, best-fit packing with certified bin counts.

Texts become token ids and then pieces of at most `capacity` tokens; only those figures move on.
Full pieces are sequences of their own. The others are dealt into groups of bounded size and each
group is packed by best-fit decreasing. Dual-feasible functions give a lower bound on the group's
bins; a group that meets it is certified. Groups with a gap keep their full bins and exchange the
pieces of the others (another hash deals them anew), and best-fit decreasing runs again, for as
long as a round saves more than one sequence in SAVING of those it packs anew; the gap that is left
is at most the sum of the last round's gaps over bounds.

Defined cases: a null text is empty and one token long (the end token); repeated rows are packed
one by one; an empty table gives no rows; extra columns are ignored. A text's ids must fit in memory.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_chunks

CAPACITY = 1024
END = 2
#: Pieces that one group packs.
GROUP = 1 << 16
#: A round that saves one sequence in this many, or fewer, is the last.
SAVING = 100_000
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoders(vocabulary: str, ranks: str):
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary)
    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return full, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})


@cache
def _special(vocabulary: str, ranks: str) -> tuple[str, ...]:
    """Texts of the vocabulary's added tokens, which are one id each."""
    return tuple(t.content for t in _encoders(vocabulary, ranks)[0].get_added_tokens_decoder().values())


def encode(texts: list[str], simple: list[bool], vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Iterator[np.ndarray]:
    """Token ids of texts. Simple texts (no code point over U+027F, where Unicode versions of the two
    libraries' letter classes agree) without added tokens take the faster library over the same vocabulary."""
    full, fast = _encoders(vocabulary, ranks)
    special = _special(vocabulary, ranks)
    for text, plain in zip(texts, simple, strict=True):
        yield fast.encode_to_numpy(text, disallowed_special=()) if plain and not any(x in text for x in special) else np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32 for every piece of every row's ids and end token."""
    d = df.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_chunks(batch, "__text"):
                data = raw.tobytes()
                odd = np.concatenate(([0], np.cumsum(raw >= 0xCA)))[offsets]
                texts = [data[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode(texts, (np.diff(odd) == 0).tolist())):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    buf, n = memoryview(ids).cast("B"), len(ids)
                    b, a, k = (n - 1) % capacity + 1, 0, 0
                    while a < n:
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(buf[4 * a : 4 * b]))
                        a, b, k = b, b + capacity, k + 1
                own = batch.column(0).slice(lo, hi - lo).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["__id", "piece", "start", "length", "ids_crc32"])

    kind = d.schema["__id"].dataType.simpleString()
    return d.mapInArrow(run, f"__id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by two families of dual-feasible functions."""
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    count, mass = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    # sizes under e count nothing, sizes over capacity - e a whole bin
    e = np.arange(capacity // 2 + 1)
    best = int((-(-((count[-1] - count[capacity - e]) * capacity + mass[capacity - e] - np.where(e, mass[np.maximum(e - 1, 0)], 0)) // capacity)).max())
    x = np.arange(capacity + 1)
    for k in range(1, 33):  # sizes rounded down to multiples of a bin's (k + 1)th, exact ones kept
        exact = (k + 1) * x % capacity == 0
        value = np.where(exact, x * k, (k + 1) * x // capacity * capacity)  # times k
        best = max(best, int(-(-(n * value).sum() // (capacity * k))))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each length, and each bin's free room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, used = 0, 0  # bit r of there: some bin has r free
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = there >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                there ^= 1 << free
        else:
            free, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - free
        left = free - size
        if not room[left]:
            there |= 1 << left
        room[left].append(b)
    free = np.zeros(used, np.int64)
    for left, some in enumerate(room):
        free[some] = left
    return bins, offsets, free


def _pack(capacity: int, turn: int):
    def run(t: pa.Table) -> pa.Table:
        lengths = t["length"].to_numpy()
        order = np.lexsort((t["__n"].to_numpy(), lengths))
        t, lengths = t.take(pa.array(order)), lengths[order]
        bins, offsets, free = best_fit(lengths, capacity)
        gap = len(free) - lower_bound(lengths, capacity)
        base = (turn << 56) | (t["__group"][0].as_py() << 24)
        out = t.select(["__id", "piece", "start", "length", "ids_crc32", "__n"])
        for name, col in (("sequence_id", base + bins), ("offset", offsets), ("__free", free[bins]), ("__gap", np.full(len(bins), gap))):
            out = out.append_column(name, pa.array(col, pa.int64()))
        return out

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group: int = GROUP, saving: int = SAVING) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(df, id_col, text, capacity).withColumn("__n", F.monotonically_increasing_id()), "pieces")
    rest = cut.where(F.col("length") < capacity)
    full = cut.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long, __free long, __gap long"

    def dealt(d: DataFrame, n: int, turn: int) -> DataFrame:
        key = F.pmod(F.xxhash64(F.lit(turn), "__n"), F.lit(max(1, -(-n // group))))  # by row: equal rows are dealt to all groups
        return stored(d.select(*cut.columns, key.alias("__group")).groupBy("__group").applyInArrow(_pack(capacity, turn), schema), "packed")

    def bins(d: DataFrame) -> int:
        return d.where("offset = 0").count()

    n = rest.count()
    packed = dealt(rest, n, 0)
    done, loose, turn = packed, None, 0
    while True:
        turn += 1
        gaps = packed.where((F.col("__gap") > 0) & (F.col("__free") > 0))
        n = gaps.count()
        if not n or turn > 126:  # a round's number is seven bits of a sequence's
            break
        before = bins(gaps)
        again = dealt(gaps, n, turn)
        saved = before - bins(again)
        if saved <= 0:
            break
        kept = packed.where((F.col("__gap") <= 0) | (F.col("__free") <= 0))
        loose = kept if loose is None else loose.unionByName(kept)
        packed = again
        done = loose.unionByName(packed)
        if saved * saving <= before:
            break
    return done.select(*cut.columns, "sequence_id", "offset").unionByName(full).drop("__n").withColumnRenamed("__id", id_col)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
