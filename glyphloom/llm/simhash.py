"""Operator 9, SimHash near-duplicates: exact links by bit-sliced comparison.

Fingerprints come from word shingles (XXH64). To link all pairs at `radius` or fewer differing
bits, the 64 bits are cut into radius + k parts: two linked fingerprints agree on at least k of
them. Each choice of k parts is a mask, and distinct fingerprints that agree under a mask form a
bucket. k follows from their number, so that a bucket of unrelated ones stays small; links found
are all links at every k.

Inside buckets, fingerprints are compared bit-sliced: position p of the bucket-sorted array is
lane p % 64 of word p / 64, plane j holds bit j of 64 fingerprints, and a fingerprint is compared
with 64 others at a time by adding the differing planes into carry-save counters. Blocks whose
lanes have all passed the radius are abandoned early, and blocks that are linked with the query
already are skipped, so a group of near copies costs about its size. Each bucket yields a
spanning star, never its pairs. Buckets over `big` are found by counting before any is gathered,
and are dealt by further parts of the bits that they do not share, again exactly. Components come
from alternating star contractions over tables in the shared folder.

Defined cases: null and empty texts have fingerprint 0 and are linked like others; texts under a
shingle's words are hashed whole; equal fingerprints are one node; a null id never names a
component unless all its ids are null; repeated rows are kept; extra columns are ignored.
keep_one takes rows, not ids: components whose ids are all null keep a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spaced, stored, superseded, table, text_chunks, word_bounds

SHINGLE = 4
RADIUS = 4
#: Fingerprints of a bucket that one task compares.
BIG = 1 << 18
#: Query-block comparisons held at a time.
TASKS = 200_000
_BLOCK = 1 << 17


# ---- fingerprints


def text_fingerprints(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """SimHash of each text (uint64)."""
    n = len(offsets) - 1
    raw, offsets = spaced(raw, offsets)
    upper = (raw >= 65) & (raw <= 90)
    raw = np.where(upper, raw + 32, raw).astype(np.uint8)
    start, end = word_bounds(raw)
    if not len(start):
        return np.zeros(n, np.uint64)
    doc = np.searchsorted(offsets, start, "right") - 1
    # words with one space after each
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    keep = ~gap
    keep[end] = True
    raw[gap] = 32
    text = raw[keep].tobytes()
    width = end - start
    last = np.cumsum(width + 1) - 1
    first = last - width
    words = np.bincount(doc, minlength=n)
    ahead = np.arange(len(doc)) + shingle - 1
    inside = ahead < len(doc)
    inside[inside] = doc[ahead[inside]] == doc[inside]
    # a text with fewer words is one shingle, from its first word to its last
    short = (words[doc] < shingle) & (np.diff(np.concatenate(([-1], doc))) > 0)
    at = np.flatnonzero(inside | short)
    to = np.where(inside[at], at + shingle - 1, at + words[doc[at]] - 1)
    own = doc[at]
    counts, bits = np.bincount(own, minlength=n), np.zeros((n, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(at), _BLOCK):
        k = slice(lo, lo + _BLOCK)
        h = np.array([digest(text[a:b], seed) for a, b in zip(first[at[k]].tolist(), last[to[k]].tolist(), strict=True)], np.uint64)
        planes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], own[k]))))
        bits[own[k][edges]] += np.add.reduceat(planes, edges, axis=0, dtype=np.int64)
    return np.packbits(2 * bits > counts[:, None], axis=1).view(np.uint64).reshape(-1)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", number: str | None = None) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a long) of every row, and its number (a long column) if one is named."""
    d = df.select(F.col(id_col).alias("__id"), *([F.col(number).alias("__row")] if number else []), F.col(text).alias("__text"))
    keys = d.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_chunks(batch, "__text"):
                fp = text_fingerprints(raw, offsets).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(keys))), pa.array(fp)], [*keys, "fp"])

    kinds = ", ".join(f"{k} {d.schema[k].dataType.simpleString()}" for k in keys)
    out = d.mapInArrow(run, f"{kinds}, fp long").withColumnRenamed("__id", id_col)
    return out.withColumnRenamed("__row", number) if number else out


# ---- links inside buckets


def _parts(bits: list[int], n: int) -> list[int]:
    """The bits as n masks of nearly equal width."""
    return [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def masks(shared: int, radius: int, k: int) -> list[int]:
    """Supersets of shared such that fingerprints that agree under shared and differ in radius bits
    or fewer agree under at least one."""
    free = [b for b in range(64) if not shared >> b & 1]
    parts = _parts(free, min(len(free), radius + k))
    return [shared | sum(c) for c in combinations(parts, max(0, len(parts) - radius))]


def parts_for(n: int, radius: int) -> int:
    """The least k for which unrelated fingerprints fill a bucket with 64 at most."""
    k = 1
    while n / 2 ** (64 * k / (radius + k)) > 64 and k < 12:
        k += 1
    return k


def _settle(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the components of u and v; labels end as the least position of each component."""
    while len(u):
        a, b = label[u], label[v]
        live = a != b
        u, v, a, b = u[live], v[live], a[live], b[live]
        if not len(u):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def bucket_links(fp: np.ndarray, start: np.ndarray, size: np.ndarray, radius: int = RADIUS, tasks: int = TASKS) -> np.ndarray:
    """fp: distinct fingerprints of each bucket one after another; start, size of the buckets.
    Returns for each position the least position that it is linked with inside its bucket."""
    n = len(fp)
    label = np.arange(n)
    if radius > 6:
        raise ValueError("counters hold up to 7 differing bits")
    words = (n + 63) // 64
    lanes = np.zeros(words * 64, np.uint64)
    lanes[:n] = fp
    plane = [np.packbits((lanes >> np.uint64(j) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for j in range(64)]
    end = np.repeat(start + size, size)
    w0, w1 = np.arange(n) >> 6, (end - 1) >> 6
    each = np.where(end - 1 > np.arange(n), w1 - w0 + 1, 0)
    upto = np.cumsum(each)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    lo = 0
    while lo < n:
        base = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, base + tasks, "right")))
        q = np.repeat(np.arange(lo, hi), each[lo:hi])
        w = w0[q] + np.arange(len(q)) - (upto[q] - each[q] - base)
        if len(q):
            # blocks that hold one component, the query's own, have nothing left to say
            tail = np.concatenate((label, np.full(words * 64 - n, -1)))[: words * 64].reshape(-1, 64) if hi - lo > 0 else None
            least, most = tail.min(1), tail.max(1)
            fresh = (least[w] != most[w]) | (least[w] != label[q])
            q, w = q[fresh], w[fresh]
        if len(q):
            first = np.maximum(q + 1 - (w << 6), 0).astype(np.uint64)
            last = np.minimum(end[q] - (w << 6), 64).astype(np.uint64)
            valid = np.where(first < 64, ones << np.minimum(first, np.uint64(63)), np.uint64(0)) & (ones >> (np.uint64(64) - last))
            alive = valid != 0
            q, w, valid = q[alive], w[alive], valid[alive]
            own = fp[q]
            c0 = np.zeros(len(q), np.uint64)
            c1, c2, over = c0.copy(), c0.copy(), c0.copy()
            for j in range(0, 64, 2):
                a = plane[j][w] ^ (np.uint64(0) - (own >> np.uint64(j) & np.uint64(1)))
                b = plane[j + 1][w] ^ (np.uint64(0) - (own >> np.uint64(j + 1) & np.uint64(1)))
                x = a ^ b
                carry = (a & b) | (c0 & x)
                c0 ^= x
                twos = c1 & carry
                c1 ^= carry
                over |= c2 & twos
                c2 ^= twos
                if j % 16 == 14:
                    near = valid & ~over & ~_beyond(c0, c1, c2, radius)
                    alive = near != 0
                    if not alive.all():
                        q, w, own, c0, c1, c2, over, valid = (z[alive] for z in (q, w, own, c0, c1, c2, over, valid))
                    if not len(q):
                        break
            if len(q):
                near = valid & ~over & ~_beyond(c0, c1, c2, radius)
                for k in range(0, len(q), 16384):
                    bit = np.unpackbits(near[k : k + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    row, lane = np.nonzero(bit)
                    _settle(label, q[k + row], (w[k + row] << 6) + lane)
        lo = hi
    return label


def _beyond(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count of 0 to 7 is over the radius."""
    found = np.zeros_like(c0)
    for v in range(radius + 1, 8):
        found |= (c0 if v & 1 else ~c0) & (c1 if v & 2 else ~c1) & (c2 if v & 4 else ~c2)
    return found


def _kernel(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if not parts:
            return
        m, key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((fp, key, m))
        m, key, fp = m[order], key[order], fp[order]
        fresh = np.concatenate(([True], (m[1:] != m[:-1]) | (key[1:] != key[:-1])))
        start = np.flatnonzero(fresh)
        size = np.diff(np.concatenate((start, [len(m)])))
        fp = fp[np.repeat(size > 1, size)]
        size = size[size > 1]
        if not len(fp):
            return
        label = bucket_links(fp.view(np.uint64), np.cumsum(size) - size, size, radius)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        for lo in range(0, len(linked), 1 << 16):
            k = linked[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(fp[k]), pa.array(fp[label[k]])], ["a", "b"])

    return run


def oversized(rows: DataFrame, count: int, big: int) -> DataFrame | None:
    """m, key of the buckets of over `big` rows, counted before any bucket meets in a task. Hashes of buckets
    are tallied first, as they add up before the shuffle; only buckets behind a full hash are counted one by
    one. Both tables have count / big rows at most."""
    if count <= big:
        return None
    d = rows.withColumn("h", F.pmod(F.xxhash64("m", "key"), F.lit(max(1024, 16 * count // big))))
    full = d.groupBy("h").count().where(F.col("count") > big).select("h")
    found = d.join(F.broadcast(full), "h", "left_semi").groupBy("m", "key").count().where(F.col("count") > big)
    found = stored(found.select("m", "key"), "simhash-oversized")
    return found if found.limit(1).count() else None


def links(nodes: DataFrame, radius: int = RADIUS, big: int = BIG) -> DataFrame:
    """nodes: distinct fp. Returns edges a, b whose components are those of all links."""
    spark = nodes.sparkSession
    n = nodes.count()
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    dealt = lambda ms: F.array(*[F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(v))).alias("key"), "fp") for k, v in ms])
    chosen = masks(0, radius, parts_for(n, radius))
    rows = nodes.select(F.explode(dealt(list(enumerate(chosen)))).alias("r")).select("r.*")
    count, found = n * len(chosen), None
    while True:
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 2_000_000 + 1)
        able = [i for i, v in enumerate(chosen) if 64 - v.bit_count() > radius]  # other buckets have 2 ** radius rows at most
        over, rest = oversized(rows if len(able) == len(chosen) else rows.where(F.col("m").isin(able)), count, big), None
        if over is not None:  # such buckets are dealt by further parts of the bits that they don't share
            rest = stored(rows.join(F.broadcast(over), ["m", "key"], "left_semi").select("m", "fp"), "simhash-rest")
            rows = rows.join(F.broadcast(over), ["m", "key"], "left_anti")
        edges = stored(rows.select("m", "key", "fp").repartition(width, "m", "key").mapInArrow(_kernel(radius), "a long, b long"), "simhash-links")
        found = edges if found is None else found.unionByName(edges)
        if rest is None:
            return found
        deep = [r[0] for r in rest.select("m").distinct().collect()]  # masks, at most as many as were chosen
        place, finer = {}, []
        for i in deep:
            ms = masks(chosen[i], radius, 2)
            place[i] = [(len(finer) + k, v) for k, v in enumerate(ms)]
            finer += ms
        keyed = None
        for i, ms in place.items():
            keyed = F.when(F.col("m") == i, dealt(ms)) if keyed is None else keyed.when(F.col("m") == i, dealt(ms))
        rows = rest.select(F.explode(keyed).alias("r")).select("r.*")
        count, chosen = rest.count() * max(map(len, place.values())), finer


# ---- components


def components(edges: DataFrame, label: str = "stars") -> DataFrame:
    """Connected components of edges a, b (longs) by alternating large and small stars:
    node, root for each node of an edge, root being the least node."""

    def measure(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    was = measure(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        old, e = e, stored(small.where("a <> b").distinct(), label)
        superseded(old)
        now = measure(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, big: int = BIG) -> DataFrame:
    """id, fp, component_id (the least id reachable over links) of every row."""
    docs = stored(fingerprints(df, id_col, text).withColumnRenamed(id_col, "__id"), "simhash")
    nodes = stored(docs.groupBy("fp").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    tree = components(links(nodes.select("fp"), radius, big))
    tree = nodes.join(tree, nodes["fp"] == tree["node"]).select("fp", "root", "least")
    top = tree.groupBy("root").agg(F.min("least").alias("top"))
    named = tree.join(top, "root").select(F.col("fp").alias("__fp"), "top")
    named = nodes.join(named, nodes["fp"] == named["__fp"], "left").select(F.col("fp").alias("__fp"), F.coalesce("top", "least").alias("component_id"), "n")
    named = stored(named, "simhash-named")
    # fingerprints of over a thousandth of all rows are a thousand at most: they are broadcast, so that a
    # large group of copies isn't dealt to one task; all others meet their rows in a shuffle
    limit = (nodes.agg(F.sum("n")).first()[0] or 0) // 1000 + 1
    hot, rest = named.where(F.col("n") > limit).drop("n"), named.where(F.col("n") <= limit).drop("n")
    few = docs.join(F.broadcast(hot), docs["fp"] == hot["__fp"])
    many = docs.join(F.broadcast(hot.select("__fp")), docs["fp"] == hot["__fp"], "left_anti").join(rest, F.col("fp") == rest["__fp"])
    return few.unionByName(many).select(F.col("__id").alias(id_col), "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, big: int = BIG) -> DataFrame:
    """One row of df for each component: the one with the least id (a null id comes last), then the least
    fingerprint, then the least stored row number. Ids may be null, and repeat within and across components."""
    rows = stored(df.withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")
    docs = fingerprints(rows.withColumnRenamed(id_col, "__key"), "__key", text, "__row")
    order = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("id"), "fp", "__row")
    nodes = stored(docs.groupBy("fp").agg(F.min(order).alias("least")), "simhash-nodes")
    tree = components(links(nodes.select("fp"), radius, big))
    named = nodes.join(tree, nodes["fp"] == tree["node"], "left").select(F.coalesce("root", "fp").alias("root"), "least")
    first = stored(named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.__row").alias("__keep")), "simhash-kept")
    # a merge join at every size: the rows to keep grow with the documents
    return rows.join(first.hint("merge"), F.col("__row") == F.col("__keep"), "left_semi").drop("__row")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
