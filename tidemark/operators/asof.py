"""Backward as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import PIECE_ROWS, cut_points, in_pieces, renamed, same


def _number(df: DataFrame, c: str) -> Column:
    """A time or number as a number, in the same order."""
    kind = df.schema[c].dataType.typeName()
    if kind == "date":
        return F.unix_date(c)
    return F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.col(c)


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, tie: list[str] | None = None, tolerance: Column | None = None, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Each row of left with the latest row of right whose right_on is at or before its left_on, for equal `by`; nulls without one.

    Both sides are put together and sorted by time, no row of one side meets all rows of the other. The time line of a key with more than
    piece_rows rows is cut at quantiles: pieces are sorted by different tasks, and the last row of right before a piece is carried into it. Of rows of
    right at one time the last by `tie` is taken. tolerance: a condition on left_on and right_on that the match must meet.
    Null keys match each other; a null time matches nothing. Columns of right must have names that left lacks.
    """
    values = [c for c in right.columns if c not in by]
    none = lambda df, cols: F.lit(None).cast(df.select(F.struct(*cols)).schema[0].dataType)
    a = left.select(*by, F.col(left_on).alias("__at"), _number(left, left_on).alias("__n"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), none(right, values).alias("__right"))
    b = right.select(*by, F.col(right_on).alias("__at"), _number(right, right_on).alias("__n"), F.lit(0).alias("__side"), none(left, left.columns).alias("__left"), F.struct(*values).alias("__right"))
    x = a.unionByName(b)
    cuts = cut_points(x.select(*by, "__n").filter("__n IS NOT NULL"), by, "__n", piece_rows)
    x = in_pieces(x, cuts, by, "__n")
    order = [F.col("__at").asc_nulls_first(), "__side", *[F.col("__right")[c] for c in tie or []]]
    w = Window.partitionBy(*by, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("__at").isNotNull(), F.col("__right")), ignorenulls=True).over(w)
    j = x.withColumn("__found", F.when(F.col("__at").isNotNull(), found)).filter("__side = 1").drop("__right")
    # of large keys, the last row of right in each piece, carried into the pieces after it
    both = [*by, "__piece"]
    ends = x.filter("__side = 0 AND __at IS NOT NULL").join(F.broadcast(renamed(cuts.select(*by), by)), same(by), "left_semi").groupBy(*both).agg(F.max_by("__right", F.struct("__at", *[F.col("__right")[c] for c in tie or []])).alias("__end"))
    every = cuts.select(*by, F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("__piece"))
    before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.join(renamed(ends, both), same(both), "left").select(*both, F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    j = j.join(renamed(carried, both), same(both), "left").withColumn("__found", F.coalesce("__found", F.when(F.col("__at").isNotNull(), F.col("__carried"))))
    out = j.select("__left.*", "__found.*")
    if tolerance is not None:
        ok = F.coalesce(tolerance, F.lit(False))
        out = out.select(*left.columns, *[F.when(ok, F.col(c)).alias(c) for c in values])
    return out
