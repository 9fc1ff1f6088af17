"""Ticks to bars, latest rows, and the bars of the authoritative retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minute_bars(ticks: DataFrame, bucket: str = "1 minute", time: str | None = None) -> DataFrame:
    """OHLCV per symbol and bucket of the event time (else the time received); ticks without a last price are left out.

    time names the column to bucket by; a stream needs its watermark's own column.

    Volume is the last cumulative volume less the first; null if negative or missing. Works on batches and streams.
    """
    t = ticks.filter(F.col("last").isNotNull())
    t = t.withColumn("at", F.coalesce("event_timestamp", "received_at")) if time is None else t.withColumn("at", F.col(time))
    order = F.struct("at", "received_at", "event_id")
    gap = F.max_by("volume", order) - F.min_by("volume", order)
    b = t.groupBy("symbol", F.window(time or "at", bucket).alias("w")).agg(
        F.min_by("last", order).alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", order).alias("close"), gap.alias("gap"), F.count("*").alias("ticks")
    )
    return b.select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", F.when(F.col("gap") >= 0, F.col("gap")).alias("volume"), "ticks")


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; Spark keeps one row per key and task before it shuffles."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def authoritative_bars(coverage: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars of the one retrieval that coverage names for each event and phase, inside its half-open bounds, first per ts.

    coverage: symbol, earnings_date, phase, received_at, expected_start, expected_end. An event's few coverage rows are one list, joined on the event alone and
    hashed: bars that are dealt by their event are not shuffled, and only those that a row names are sorted for the first per ts.
    """
    key = ["symbol", "earnings_date"]
    c = coverage.groupBy(*key).agg(F.collect_list(F.struct("phase", "received_at", "expected_start", "expected_end")).alias("__covered"))
    named = lambda c: (c["phase"] == F.col("phase")) & (c["received_at"] == F.col("received_at")) & (F.col("ts") >= c["expected_start"]) & (F.col("ts") < c["expected_end"])
    j = bars.join(c.hint("shuffle_hash"), key).filter(F.exists("__covered", named)).drop("__covered")
    return latest_per_key(j, [*key, "phase", "ts"], F.col("id").asc())


def coverage_summary(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """Per event and phase of expected (expected_minutes): first, last and distinct minutes seen, missing ones, ratio and flags."""
    key = ["symbol", "earnings_date", "phase"]
    each = bars.groupBy(*key, "minute").agg(F.count("*").alias("rows"))
    b = each.groupBy(*key).agg(F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"), F.count("*").cast("int").alias("observed"), F.sum("rows").alias("rows"))
    o = expected.join(b, key, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    flags = F.array_compact(F.array(F.when(F.col("observed") == 0, F.lit("no_bars_in_requested_phase")), F.when(F.col("rows") > F.col("observed"), F.lit("duplicate_minute_bars"))))
    return o.select(
        *key, "first_minute", "last_minute", "observed", F.greatest(F.col("expected_minutes") - F.col("observed"), F.lit(0)).alias("missing"),
        F.least(F.lit(1.0), F.col("observed") / F.col("expected_minutes")).alias("ratio"), F.array_join(flags, ",").alias("flags"),
    )


def changed_snapshots(df: DataFrame, key: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Rows whose cols differ (null-safe) from the key's row before; the first row of a key counts as changed."""
    w = Window.partitionBy(*key).orderBy(*order)
    now = F.struct(*cols)
    d = df.withColumn("__first", F.row_number().over(w) == 1).withColumn("__before", F.lag(now).over(w))
    return d.filter(F.col("__first") | ~F.col("__before").eqNullSafe(now)).drop("__first", "__before")
