"""Which events and symbols a job works on, notes to store, and shapes for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reaction import KEY


def live_after_close(events: DataFrame) -> DataFrame:
    return events.filter((F.col("hour") == "amc") & ~F.col("illiquid") & ~F.col("superseded"))


def active_symbols(events: DataFrame, days: DataFrame, dates: DataFrame) -> DataFrame:
    """For each day of dates: the symbols with a live event between its previous and its next session.

    Windows are days of the calendar, so days (one row a day) are unfolded and joined on the date: no range join.
    """
    span = dates.select("day").distinct().join(F.broadcast(days.select("day", "previous", "next")), "day").filter("previous IS NOT NULL AND next IS NOT NULL")
    each = span.select("day", F.explode(F.sequence("previous", "next")).alias("earnings_date"))
    return live_after_close(events).join(F.broadcast(each), "earnings_date").select("day", "symbol").distinct()  # a few rows for each day of the calendar


def capture_candidates(events: DataFrame, coverage: DataFrame, phase: str) -> DataFrame:
    """Live after-close events that lack coverage of a phase."""
    return live_after_close(events).select(*KEY).join(coverage.filter(F.col("phase") == phase), list(KEY), "left_anti")


def captured_and_pending(events: DataFrame, quotes: DataFrame) -> DataFrame:
    """Live after-close events: captured if a quote with a last price was seen, else pending."""
    seen = quotes.filter("last IS NOT NULL").select(*KEY).distinct().withColumn("seen", F.lit(True))
    state = F.when(F.col("seen"), "captured").otherwise("pending")
    return live_after_close(events).select(*KEY).join(seen, list(KEY), "left").select(*KEY, state.alias("state"))


def clean_notes(notes: DataFrame) -> DataFrame:
    """author, body and tags trimmed, tags lower-cased, without blanks and repeats in order; `rejected` names a blank author or body."""
    tidy = F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    n = notes.withColumns({"author": F.trim("author"), "body": F.trim("body"), "tags": tidy})
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return n.withColumn("rejected", F.when(blank("author"), "author").when(blank("body"), "body"))


def outcome_choice(outcomes: DataFrame) -> DataFrame:
    """One outcome per event: a complete one first, then the smallest evidence digest."""
    w = Window.partitionBy(*KEY).orderBy((F.col("status") != "complete").cast("int"), "evidence_sha256")
    return outcomes.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def path_tail(bars: DataFrame, minutes: int = 30) -> DataFrame:
    """The last so many minutes up to each event's last regular bar, and all later bars, with `part` naming which."""
    reg = F.col("phase") == "earnings_regular"
    b = bars.withColumn("last", F.max(F.when(reg, F.col("minute"))).over(Window.partitionBy(*KEY)))
    return b.filter(~reg | (F.col("minute") > F.col("last") - minutes)).withColumn("part", F.when(reg, "regular_tail").otherwise("postmarket")).drop("last")


def daily_context(events: DataFrame, daily: DataFrame, before: int = 120, after: int = 30) -> DataFrame:
    """Sessions before and after each event's first session on or after it, by session number; after its symbol's last session, around that.

    The session number comes from one ordered pass over events and sessions, the sessions around it from an equi-join on symbol and number.
    """
    w = Window.partitionBy("symbol")
    both = daily.select("symbol", F.col("session_date").alias("at"), F.lit(1).alias("side")).unionByName(events.select("symbol", F.col("earnings_date").alias("at"), F.lit(0).alias("side")))
    earlier = F.sum("side").over(w.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = both.withColumn("first", F.least(earlier + 1, F.sum("side").over(w))).filter("side = 0 AND first > 0")
    each = placed.select("symbol", F.col("at").alias("earnings_date"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("rel"), "first")
    days = daily.withColumn("n", F.row_number().over(w.orderBy("session_date")))
    return each.withColumn("n", (F.col("first") + F.col("rel")).cast("int")).drop("first").join(days, ["symbol", "n"]).drop("n")


def development_split(events: DataFrame, holdout: float) -> DataFrame:
    """One row: the period of all events, by days; its last share, to the nearest day (halves to the even one), is held out."""
    if not 0 < holdout < 1:
        raise ValueError("holdout must lie between 0 and 1")
    e = events.agg(F.min("earnings_date").alias("first"), F.max("earnings_date").alias("last"))
    cut = F.date_sub("last", F.bround(F.datediff("last", "first") * F.lit(float(holdout))).cast("int"))
    return e.select(F.col("first").alias("development_from"), F.date_sub(cut, 1).alias("development_to"), cut.alias("oos_from"), F.col("last").alias("oos_to"))
