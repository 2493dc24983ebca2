"""Operator 7, mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share `share` of all
words by weight; a target stops at `most` times its source's words and what is over is shared anew.

Each document gets the rate nearest to 1 in relative entropy for which its source's words meet the
target: exp(l * size / scale), at most `most`. The multipliers l of the dual solve one equation for
each source. Newton iterations, each one distributed aggregation over (source, size) cells with a
bracket as a safeguard, find all of them at once. Sums are of integers, so reruns agree exactly.

Rates are rounded into copies by systematic rounding through a source's sizes in order, which is
off by one document at most; one document of the source then takes the remaining words as a
shortened or extended copy. Cells are counted by (source, size, salt), so neither a hot source nor a
hot size meets in one task: a source has a row for each distinct size, a size one for each salt.

Defined cases: null and empty texts have size 0 and are not taken; a null source is a source; equal
rows are separate documents; a source without words has target 0; an empty table gives no rows;
extra columns are ignored (mix) or kept (mixed_documents).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, superseded, table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SALTS = 256
#: Words are counted in this many parts, so that sums of rates are sums of integers.
GRAIN = 1024
STEPS = 60
#: Newton steps between two stored tables.
PER_TABLE = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Sorts like the source by code point, with null after all."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def ranked(df: DataFrame, col: str, label: str) -> DataFrame:
    """df with `rank`, from 0, by the order of a column without repeats; no task sees all rows."""
    blocks = stored(df.repartitionByRange(col).withColumn("__block", F.spark_partition_id()), label)
    counts = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__block").orderBy(col)) - 1
    return blocks.withColumn("__in", inside).join(counts, "__block").withColumn("rank", F.col("__in") + F.col("__before")).drop("__in", "__before", "__block")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources: k (sort key), words. Adds weight and target."""
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    s = stored(ranked(sources, "k", "mix-ranks").withColumn("weight", pick).drop("rank"), "mix-sources")
    first = s.agg(F.sum("words"), F.sum("weight")).first()
    goal = share * (first[0] or 0)
    level = goal / first[1] if first[1] else 0.0
    while True:  # the level at which uncapped sources get level * weight
        over = F.col("weight") * level > most * F.col("words")
        capped, left = s.agg(F.sum(F.when(over, most * F.col("words"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not left:
            level = math.inf
            break
        new = (goal - (capped or 0)) / left
        if new <= level:
            break
        level = new
    return s.withColumn("target", F.least((most * F.col("words")).cast("double"), F.col("weight") * F.lit(level)) if math.isfinite(level) else (most * F.col("words")).cast("double"))


def rate(multiplier: Column, size: Column, scale: Column, most: int = MOST) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(700.0), multiplier * size / scale)))


def multipliers(cells: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """cells: k, size, docs; goals: k, words, target, scale. Returns k, scale, l for the sources that have words
    and whose target is not all that they can give."""
    top = math.log(most)
    state = goals.where((F.col("words") > 0) & (F.col("target") < most * F.col("words"))).select(
        "k", "scale", "target", F.lit(0.0).alias("l"),
        (F.least(F.lit(0.0), F.log(F.greatest("target", F.lit(1e-300)) / F.col("words"))) * F.col("scale")).alias("lo"), (F.lit(top) * F.col("scale")).alias("hi"), F.lit(False).alias("done"),
    )
    state = stored(state, "mix-dual")

    def newton(state: DataFrame) -> DataFrame:
        d = cells.where("size > 0").join(state, "k")
        r = rate(F.col("l"), F.col("size"), F.col("scale"), most)
        words = F.col("docs") * F.col("size")
        sums = d.groupBy("k").agg(
            *[F.first(c).alias(c) for c in ("scale", "target", "l", "lo", "hi", "done")],
            F.sum((words * GRAIN * r).cast("long")).alias("f"),
            F.sum((words * GRAIN * F.when(r < most, r * F.col("size") / F.col("scale")).otherwise(0.0)).cast("long")).alias("g"),
        )
        d = sums.withColumn("off", F.col("f") / GRAIN - F.col("target"))
        lo, hi = F.when(F.col("off") <= 0, F.col("l")).otherwise(F.col("lo")), F.when(F.col("off") >= 0, F.col("l")).otherwise(F.col("hi"))
        next_ = F.when(F.col("g") > 0, F.col("l") - F.col("off") * GRAIN / F.col("g"))
        step = F.when((next_ > lo) & (next_ < hi), next_).otherwise((lo + hi) / 2)
        near = F.col("done") | (F.abs("off") <= 0.5) | (hi - lo <= 1e-12 * F.greatest(F.lit(1.0), F.abs("l")))
        return d.select("k", "scale", "target", F.when(near, F.col("l")).otherwise(step).alias("l"), lo.alias("lo"), hi.alias("hi"), near.alias("done"))

    for _ in range(0, STEPS, PER_TABLE):
        seen, new = Observation(), state
        for _ in range(PER_TABLE):
            new = newton(new)
        old, state = state, stored(new.observe(seen, F.count_if(~F.col("done")).alias("open")), "mix-dual")
        superseded(old)
        if not seen.get.get("open"):
            break
    return state.select("k", "scale", "l")


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, number: str | None = None) -> DataFrame:
    """id, size, source_size, target, taken, and the row's number (a column) if one is named."""
    row = [F.col(number).alias("__row")] if number else []
    d = df.select(F.col(id_col).alias("__id"), *row, _key(F.col(source)).alias("k"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("__said"))
    # rows that share an id are told apart by their texts, rows without one by their place
    own = F.xxhash64(F.coalesce(F.col("__id"), F.monotonically_increasing_id()), "__said")
    docs = stored(d.withColumn("salt", F.pmod(own, F.lit(SALTS)).cast("int")), "mix-sizes")
    salted = stored(docs.groupBy("k", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "mix-salted")
    cells = stored(salted.groupBy("k", "size").agg(F.sum("n").alias("docs")), "mix-cells")
    sums = cells.groupBy("k").agg(F.sum(F.col("size") * F.col("docs")).alias("words"), F.greatest(F.lit(1), F.max("size")).cast("double").alias("scale"))
    goals = stored(targets(sums, weights, share, most), "mix-goals")
    dual = multipliers(cells, goals, most)
    # copies of each cell, by systematic rounding in order of size
    c = cells.where("size > 0").join(goals.select("k", "words", "target"), "k").join(dual, "k", "left")
    full = F.col("target") >= most * F.col("words")
    mass = F.col("docs") * F.when(full, F.lit(float(most))).otherwise(rate(F.col("l"), F.col("size"), F.col("scale"), most))
    upto = W.partitionBy("k").orderBy("size").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = c.withColumn("mass", mass).withColumn("end", F.floor(F.sum("mass").over(upto) + 0.5))
    c = c.withColumn("copies", F.least(F.col("end") - F.coalesce(F.lag("end").over(W.partitionBy("k").orderBy("size")), F.lit(0)), most * F.col("docs")))
    c = stored(c.select("k", "size", "docs", "copies", "target"), "mix-copies")
    # one document takes what is left: in the least size that can, or else in the largest
    left = c.groupBy("k").agg((F.round(F.first("target")) - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("left"))
    able = F.when(F.col("left") > 0, F.col("copies") < most * F.col("docs")).otherwise(F.col("copies") > 0)
    fits = F.when(F.col("size") >= F.abs("left"), -F.col("size")).otherwise(F.col("size") - F.lit(1 << 62))
    spot = c.join(left.where("left <> 0"), "k").where(able).groupBy("k").agg(F.max_by("size", fits).alias("size"), F.first("left").alias("left"))
    c = c.join(spot, ["k", "size"], "left").withColumn("left", F.coalesce("left", F.lit(0)))
    before = W.partitionBy("k", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    plan = salted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(c.drop("target"), ["k", "size"], "left")
    plan = stored(plan.join(goals.select("k", "words", "target"), "k"), "mix-plan")
    place = F.row_number().over(W.partitionBy("k", "size", "salt").orderBy(F.xxhash64("__id", F.lit(7)), "__id", "__said", *(["__row"] if number else [])))
    d = docs.withColumn("place", place).join(plan, ["k", "size", "salt"]).withColumn("place", F.col("place") + F.col("before"))
    base = F.expr("copies DIV docs")
    copies = base + (F.col("place") <= F.col("copies") - base * F.col("docs")).cast("long")
    own = F.when((F.col("left") > 0) & (F.col("place") == F.col("docs")), F.col("left")).when((F.col("left") < 0) & (F.col("place") == 1), F.col("left")).otherwise(0)
    taken = F.greatest(F.lit(0), F.least(most * F.col("size"), copies * F.col("size") + own))
    return d.select(F.col("__id").alias(id_col), "size", F.col("words").alias("source_size"), "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), *([F.col("__row").alias(number)] if number else []))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars") -> DataFrame:
    """The mix itself: each row of df as often as it is taken; what is taken of a document beyond
    whole copies is one copy of its first words, joined by spaces (length is then its code points)."""
    names = df.columns
    rows = stored(df.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")  # ids may be null or repeat
    taken = stored(mix(rows, id_col, text, source, number="__row").where("taken > 0").select("__row", F.col("size").alias("__size"), F.col("taken").alias("__taken")), "mix-taken")
    d = rows.join(taken.hint("merge"), "__row")  # what is taken grows with the documents
    whole, part = F.expr("__taken DIV __size"), F.col("__taken") % F.col("__size")
    d = d.withColumn("__copy", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))))
    cut = F.array_join(F.slice(F.array_remove(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), ""), F.lit(1), F.greatest(F.lit(1), F.col("__copy").cast("int"))), " ")
    d = d.withColumn(text, F.when(F.col("__copy") > 0, cut).otherwise(F.col(text)))
    if length in names:
        d = d.withColumn(length, F.when(F.col("__copy") > 0, F.char_length(F.col(text)).cast(df.schema[length].dataType)).otherwise(F.col(length)))
    return d.select(*[F.col(f"`{c}`") for c in names])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
