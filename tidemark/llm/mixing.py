"""Mixing sources to target weights: hash-threshold histograms, DataFrame operations only.

A document's 64-bit hash decides whether a mix takes it: all hashes below a source's threshold are in. The threshold
for a word budget comes from sums of sizes by source and hash bucket; only the bucket in which the budget ends is
split further, level by level. Nothing is sorted, and a larger budget keeps every document of a smaller one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, join_small, materialize, words

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3

#: Bits of the hash that each level of the histogram reads.
LEVELS = (12, 12, 40)


def mix_targets(by_source: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """by_source (source, source_size) with target: the sources' shares of all sizes by weight.

    Sources by code point, null last, take the weights in turn. A target stops at `most` times its source's size and
    the excess is shared again by weight: target = least(most * size, level * weight), where `level` is found from
    the sources in the order in which they reach their stop.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % n + 1).cast("int"))
    s = by_source.withColumn("weight", w).withColumn("stop", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy()),
            "stopped": F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
    everywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level")), ignorenulls=True).over(everywhere)
    return s.withColumn("level", level).select(
        "source", "source_size", F.least(F.col("stop").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size (words; null text: 0) and the hash that orders the documents of a source.

    Rows with the same key and text share a hash and are taken together.
    """
    return docs.select(F.col(key), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64(key, text).alias("h"))


def thresholds(base: DataFrame, budgets: DataFrame, n_sources: int, levels: Sequence[int] = LEVELS) -> DataFrame:
    """For each source of budgets (source, budget): `below`, the unsigned hash that the sum of sizes reaches budget at.

    Documents with a hash under `below` (as hash XOR the sign bit) hold at most the budget, or, if nearer, one more
    document. Budgets of zero or less take nothing.
    """
    # `lo` is the start of the bucket in which the budget ends, `rest` the budget left there.
    found = budgets.select("source", F.col("budget").alias("rest"), F.lit(None).cast("long").alias("lo"))
    used = 0
    for bits in levels:
        left = 64 - used
        joined = join_small(base, found, n_sources, ["source"], salt="h")
        inside = F.lit(True) if not used else F.shiftrightunsigned("h", left) == F.col("lo")
        bucket = F.shiftrightunsigned("h", left - bits) if left > bits else F.col("h").bitwiseXOR(F.lit(-(2**63)))
        sums = joined.filter(inside & (F.col("rest") > 0)).groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        w = Window.partitionBy("source").orderBy("b")
        sums = sums.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
        if left > bits:
            hit = sums.filter((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
            found = materialize(hit.select("source", (F.col("rest") - F.col("before")).alias("rest"), F.col("b").alias("lo")), f"mix_level_{used}")
        else:
            # Single documents now: the last one is in if that brings the sum nearer.
            near = F.col("upto") - F.col("rest") < F.col("rest") - F.col("before")
            take = sums.filter((F.col("upto") <= F.col("rest")) | near).groupBy("source").agg(F.max("b").alias("last"))
            out = found.alias("f").join(take.alias("t"), F.col("f.source").eqNullSafe(F.col("t.source")), "left")
            start = F.shiftleft("f.lo", left).bitwiseXOR(F.lit(-(2**63)))
            found = materialize(out.select("f.source", F.coalesce(F.try_add("t.last", F.lit(1)), "t.last", start).alias("below")), "mix_below")
        used += bits
    return found


def mix_plan(base: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> tuple[DataFrame, int]:
    """How often each source of base (source, size, h) is taken, and how many sources there are.

    Columns: source, source_size, target, whole (times that every document is taken) and below (see thresholds).
    """
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(mix_targets(by_source, weights, most), "mix_targets")
    n = targets.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    below = thresholds(base, targets.select("source", "budget"), n)
    return targets.alias("t").join(below.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left").select("t.*", "b.below").drop("budget"), n


def take(rows: DataFrame, plan: DataFrame, n_sources: int, most: int = MOST_REPEATS) -> DataFrame:
    """rows (source, h and others) with source_size, target and copies, the times that the plan takes each."""
    out = join_small(rows, plan, n_sources, ["source"], salt="h")
    one = F.when(F.col("h").bitwiseXOR(F.lit(-(2**63))) < F.col("below"), F.lit(1)).otherwise(F.lit(0))
    return out.withColumn("copies", F.least(F.col("whole") + one, F.lit(most))).drop("whole", "below")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: key, source, size, source_size, target, copies and taken (= copies * size).

    A source whose target exceeds its size takes every document floor(target / size) times and, of the next repeat,
    the documents under its threshold. Null sources are one source; null keys, empty texts and an empty table are allowed
    (a document of size 0 takes 0). The same rows give the same result, in any order and partitioning.
    """
    base = materialize(sized(docs, key, text, source), "mix_sizes")
    out = take(base, *mix_plan(base, weights, most), most)
    return out.select(key, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_taken(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    base = materialize(sized(docs, key, text, source), "mix_sizes")
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.xxhash64(key, text).alias("h"))
    out = take(rows, *mix_plan(base, weights, most), most).filter(F.col("copies") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents: a row each, repeats included; nulls, empties and ties as it says."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
