"""Realized moves and the live snapshot: one conditional aggregate each, over all events at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import merge_flags, pct_change, reasons, surprise_pct
from .reaction import KEY, THRESHOLD_PCT

#: Seconds beyond which a quote counts as old (fixed value).
OLD_QUOTE = 60


def realized_moves(events: DataFrame, candles: DataFrame) -> DataFrame:
    """Reaction, gap and total move of events whose day before and day after are captured; null where a window has no candle.

    candles: symbol, earnings_date, capture_window, ts, open, close. The surprise has the estimate's sign as base.
    """
    at = lambda window: F.when(F.col("capture_window") == window, F.col("ts"))
    c = candles.groupBy(*KEY).agg(
        F.max_by("close", at("day_before")).alias("pre_close"), F.max_by("close", at("after_hours")).alias("ah_close"),
        F.min_by("open", at("day_after")).alias("post_open"), F.max_by("close", at("day_after")).alias("post_close"),
    )
    j = events.filter("day_before_captured AND day_after_captured").select(*KEY, "eps_estimate", "eps_actual").join(c, list(KEY), "left")
    pre = F.col("pre_close")
    return j.select(
        *KEY, "pre_close", "ah_close", "post_open", "post_close", pct_change(pre, F.col("ah_close")).alias("reaction_move"), pct_change(pre, F.col("post_open")).alias("gap_move"),
        pct_change(pre, F.col("post_close")).alias("total_move"), pct_change(F.col("eps_estimate"), F.col("eps_actual")).alias("eps_surprise"),
    )


def provisional_path(bars: DataFrame, threshold: float = THRESHOLD_PCT, dealt: bool = False) -> DataFrame:
    """Per event, from whatever minutes exist: the latest regular close, the last move from it and the first move of threshold or more.

    bars: symbol, earnings_date, phase, minute, close, received_at; the latest retrieval of a minute counts. One shuffle, on the event,
    and none if bars are dealt by it already (dealt).
    """
    reg = F.col("phase") == "earnings_regular"
    b = (bars if dealt else bars.repartition(*KEY)).groupBy(*KEY, "phase", "minute").agg(F.max_by("close", "received_at").alias("close"))
    b = b.withColumn("pre", F.max_by("close", F.when(reg, F.col("minute"))).over(Window.partitionBy(*KEY)))
    b = b.withColumn("cr", F.when(~reg & (F.col("pre") > 0), pct_change(F.col("pre"), F.col("close")))).withColumn("post", F.when(~reg, F.col("minute")))
    hit = F.when(F.abs("cr") >= threshold, F.col("minute"))
    return b.groupBy(*KEY).agg(
        F.max("pre").alias("pre_close"), F.max_by("cr", "post").alias("provisional_move"), F.max("post").alias("last_minute"), F.count("post").alias("minutes"),
        (F.min(hit) + 1).alias("cross_minute"), F.min_by("cr", hit).alias("cross_pct"),
    )


def told_flags(flags: Column, stale: Column) -> Column:
    """A quote's quality flags without `stale` where the quote is said to be stale anyway."""
    return F.filter(flags, lambda f: ~((f == "stale") & F.coalesce(stale, F.lit(False))))


def today_snapshot(events: DataFrame, features: DataFrame, quotes: DataFrame, bars: DataFrame, threshold: float = THRESHOLD_PCT, dealt: bool = False) -> DataFrame:
    """Live after-close events with their latest quote, provisional path, finished class and why the numbers may mislead.

    quotes: symbol, earnings_date, received_at, bid, ask, last, stale, age_seconds, quality_flags (array). The quote's flags stand among the reasons, `stale` but once.
    Only finished rows (final) may be compared with history. dealt: as provisional_path() says.
    """
    q = quotes.groupBy(*KEY).agg(F.max_by(F.struct("received_at", "bid", "ask", "last", "stale", "age_seconds", "quality_flags"), "received_at").alias("q"))
    live = events.filter((F.col("hour") == "amc") & ~F.col("illiquid") & ~F.col("superseded")).select(*KEY, "eps_estimate", "eps_actual")
    j = live.join(provisional_path(bars, threshold, dealt), list(KEY), "left").join(q, list(KEY), "left").join(features.select(*KEY, "reaction_class"), list(KEY), "left")
    mid, spread, age = (F.col("q.bid") + F.col("q.ask")) / 2, F.col("q.ask") - F.col("q.bid"), F.col("q.age_seconds")
    why = merge_flags(
        reasons((F.col("q.received_at").isNull(), "no_quote"), (F.col("q.stale"), "stale_quote"), (age > OLD_QUOTE, "old_quote"), (F.col("pre_close").isNull(), "no_pre_close")),
        told_flags(F.col("q.quality_flags"), F.col("q.stale")), reasons((F.col("reaction_class").isNull(), "not_final")),
    )
    return j.select(
        *KEY, surprise_pct(F.col("eps_actual"), F.col("eps_estimate")).alias("eps_surprise"), "pre_close", "q.bid", "q.ask", "q.last", "q.received_at", spread.alias("spread"),
        F.when(mid != 0, spread / mid * 100).alias("spread_pct"), "provisional_move", "last_minute", F.coalesce("minutes", F.lit(0)).alias("minutes"), "cross_minute", "cross_pct",
        F.col("reaction_class").isNotNull().alias("final"), "reaction_class", F.array_join(why, ",").alias("degraded"),
    )
