"""Integrity checks: keys, references and append-only snapshots, each as a frame of what breaks the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import renamed, same


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """key and n of keys that more than one row has; counts are summed up before the shuffle."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """key and n of keys without a parent; keys are grouped first, so that a hot key is one row of the join."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).join(parents.select(*key).distinct(), key, "left_anti")


def partition_digests(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and a digest of each partition's rows as a multiset: their number, and sums and exclusive ors of two hashes. Summed up before the shuffle."""
    h = [F.xxhash64(F.lit(seed), *rows.columns) for seed in (1, 2)]
    sums = [F.sum(x.cast("decimal(38,0)")).alias(f"sum_{i}") for i, x in enumerate(h)]
    return rows.groupBy(*by).agg(F.struct(F.count("*").alias("rows"), *sums, *[F.bit_xor(x).alias(f"xor_{i}") for i, x in enumerate(h)]).alias("digest"))


def changed_rows(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of the older snapshot that the newer one no longer has as they were, repeats counted; empty if only rows were added.

    by: the columns that both snapshots are partitioned by. Partitions are compared by their digests then, and only rows of those that differ are
    shuffled; the list of these, a row a partition, is broadcast. Without `by` both snapshots are shuffled whole.
    """
    new = new.select(*old.columns)
    if by is None:
        return old.exceptAll(new)
    now = renamed(partition_digests(new, by).withColumnRenamed("digest", "now"), by)
    differ = partition_digests(old, by).join(now, same(by), "left").filter(~F.col("digest").eqNullSafe(F.col("now"))).select(*by)
    differ = F.broadcast(renamed(differ, by))
    return old.join(differ, same(by), "left_semi").exceptAll(new.join(differ, same(by), "left_semi"))
