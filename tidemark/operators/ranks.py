"""Exact ranks of large groups: a group's values are cut into pieces at quantiles, so that no task sorts a whole group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a piece, about, and the most pieces of a group.
PIECE_ROWS, MOST_PIECES = 1_000_000, 1024


def same(by: Sequence[str], prefix: str = "__k_") -> Column:
    """Null-safe equality of the columns `by` with those of renamed()."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in by], F.lit(True))


def renamed(df: DataFrame, by: Sequence[str], prefix: str = "__k_") -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in by})


def _grid(value: str) -> Column:
    """Approximate quantiles of a column at every 1/MOST_PIECES."""
    return F.expr(f"percentile_approx(`{value}`, array({','.join(f'{k / MOST_PIECES!r}D' for k in range(1, MOST_PIECES))}), {2 * MOST_PIECES})")


def cut_points(rows: DataFrame, by: Sequence[str], value: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """by and cuts (rising values of column `value`) of each group of more than piece_rows rows; smaller groups are left out.

    Groups are counted first, and only the large ones have their quantiles sketched; all cuts together are about twice the rows over piece_rows at most.
    Where the cuts lie changes the balance of pieces, never a result.
    """
    large = rows.groupBy(*by).agg(F.count("*").alias("__size")).filter(F.col("__size") > piece_rows)
    near = rows.join(F.broadcast(renamed(large, by)), same(by)).groupBy(*by, "__size").agg(_grid(value).alias("__grid"))
    return _thinned(near, by, piece_rows)


def _thinned(near: DataFrame, by: Sequence[str], piece_rows: int) -> DataFrame:
    """Of a grid of quantiles (__grid) as many as cut __size rows into pieces of piece_rows."""
    pieces = F.least(F.lit(MOST_PIECES), F.ceil(F.col("__size") / piece_rows)).cast("int")
    every = F.transform(F.sequence(F.lit(1), pieces - 1), lambda k: F.element_at("__grid", F.greatest(F.lit(1), (k * MOST_PIECES / pieces).cast("int"))))
    return near.select(*by, F.array_sort(F.array_distinct(every)).alias("cuts"))


def in_pieces(rows: DataFrame, cuts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """rows with `__piece`, the number of their group's cuts below their value: 0 in groups without cuts, and for a null value."""
    piece = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(value))), F.lit(0))
    with_cuts = renamed(cuts, by).withColumnRenamed("cuts", "__cuts")
    keep = [c for c in rows.columns]
    return rows.join(F.broadcast(with_cuts), same(by), "left").select(*keep, F.when(F.col(value).isNull() | F.col("__cuts").isNull(), 0).otherwise(piece).alias("__piece"))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """by, n and q (array<double>, as probs): exact interpolated quantiles of each group's numbers, nulls left out; groups without a number have no row.

    One plan, run when its result is asked for. Equal values are summed up before they are shuffled; then pieces of a group are counted, and of each
    piece that a rank falls into the values are numbered. `by` may be empty: one group of all rows.
    """
    keys = list(by) or ["__all"]
    x = rows.withColumn("__all", F.lit(0)) if not by else rows
    x = x.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    # what reads x below asks for the same columns each time, so that Spark shuffles it once and reads that again
    near = x.groupBy(*keys).agg(F.count("*").alias("__size"), F.max("__c").alias("__most"), _grid("__v").alias("__grid"))
    cuts = _thinned(near.filter((F.col("__size") > piece_rows) & (F.col("__most") > 0)), keys, piece_rows)
    x = in_pieces(x, cuts, keys, "__v").repartition(*[F.col(k) for k in keys], F.col("__piece"))
    upto = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, 0)
    pieces = x.groupBy(*keys, "__piece").agg(F.sum("__c").alias("__rows"), F.max("__v").alias("__top")).filter(F.col("__top").isNotNull()).drop("__top")
    pieces = pieces.withColumn("__end", F.sum("__rows").over(upto)).withColumn("n", F.sum("__rows").over(Window.partitionBy(*keys)))
    ranks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        ranks += [F.struct(F.lit(i).alias("i"), F.lit(s).alias("side"), F.least(F.floor(at) + s, F.col("n") - 1).alias("rank"), (at - F.floor(at)).alias("part")) for s in (0, 1)]
    wanted = pieces.select("*", F.inline(F.array(*ranks))).filter((F.col("rank") >= F.col("__end") - F.col("__rows")) & (F.col("rank") < F.col("__end")))
    wanted = wanted.select(*keys, "__piece", "n", "i", "side", "part", (F.col("rank") - F.col("__end") + F.col("__rows")).alias("__rank"))
    own = Window.partitionBy(*keys, "__piece").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    both = [*keys, "__piece"]
    some = x.join(renamed(wanted.select(*both).distinct(), both), same(both), "left_semi").withColumn("__upto", F.sum("__c").over(own))
    hit = some.join(renamed(wanted, both), same(both)).filter((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__c")))
    side = lambda i, s: F.max(F.when((F.col("i") == i) & (F.col("side") == s), F.col("__v")))
    part = lambda i: F.max(F.when(F.col("i") == i, F.col("part")))
    q = F.array(*[side(i, 0) + F.when(part(i) > 0, (side(i, 1) - side(i, 0)) * part(i)).otherwise(0.0) for i in range(len(probs))])
    return hit.groupBy(*keys).agg(F.max("n").alias("n"), q.alias("q")).select(*by, "n", "q")
