"""Exchange sessions by rule, their neighbours and the bounds of capture phases.

A calendar has one row a day, so its size is bounded by its years (a century is 36,525 rows): it may be broadcast
and ordered in one window. One-off closings come in as an overrides frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"

#: Wall-clock hours of the session and of the phases around it; the years in which two holidays began.
PREMARKET, OPEN, CLOSE, EARLY_CLOSE, POSTMARKET_END = (7, 0), (9, 30), (16, 0), (13, 0), (20, 0)
KING_DAY_FROM, JUNETEENTH_FROM = 1998, 2022

#: Phase: whether it belongs to the session after the event's, its first and its last column.
PHASES = {
    "earnings_regular": (False, "open", "close"),
    "earnings_postmarket": (False, "close", "post_end"),
    "following_premarket": (True, "pre_start", "open"),
    "following_regular": (True, "open", "close"),
}


def good_friday(year: Column) -> Column:
    """Two days before Easter Sunday, by the Gregorian computus."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = h + w - 7 * div(a + 11 * h + 22 * w, 451) + 114
    return F.date_sub(F.make_date(year, div(n, 31), n % 31 + 1), 2)


def _holiday(day: Column) -> Column:
    """Whether a weekday is a full holiday."""
    y, m, n, wd = F.year(day), F.month(day), F.dayofmonth(day), F.weekday(day)
    monday = wd == 0

    def observed(month: int, at: int, back: bool = True) -> Column:
        on = (m == month) & ((n == at) | (monday & (n == at + 1)))
        return on | ((m == month) & (wd == 4) & (n == at - 1)) if back else on

    return (
        observed(1, 1, back=False)  # a New Year's Day on a Saturday is not moved to the year before
        | ((y >= KING_DAY_FROM) & (m == 1) & monday & n.between(15, 21))
        | ((m == 2) & monday & n.between(15, 21))
        | (day == good_friday(y))
        | ((m == 5) & monday & (n >= 25))
        | ((y >= JUNETEENTH_FROM) & observed(6, 19))
        | observed(7, 4)
        | ((m == 9) & monday & (n <= 7))
        | ((m == 11) & (wd == 3) & n.between(22, 28))
        | observed(12, 25)
    )


def _early(day: Column) -> Column:
    m, n, wd = F.month(day), F.dayofmonth(day), F.weekday(day)
    return ((m == 11) & (wd == 4) & n.between(23, 29)) | ((m == 12) & (n == 24)) | ((m == 7) & (n == 3) & (wd < 4))


def calendar(spark: SparkSession, first_year: int, last_year: int, overrides: DataFrame | None = None) -> DataFrame:
    """One row a day: day, is_session, early_close, previous, next (strictly before and after) and latest (on or before) session.

    overrides: day, is_session, early_close; a day that is given there follows it. Neighbours past the ends are null.
    """
    span = F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))
    days = spark.range(1).select(F.explode(span).alias("day"))
    days = days.withColumn("is_session", (F.weekday("day") < 5) & ~_holiday(F.col("day"))).withColumn("early_close", F.col("is_session") & _early(F.col("day")))
    if overrides is not None:
        o = overrides.groupBy("day").agg(F.bool_and("is_session").alias("_s"), F.bool_or("early_close").alias("_e"))
        days = days.join(o, "day", "left").select("day", F.coalesce("_s", "is_session").alias("is_session"), F.coalesce("_e", "early_close").alias("early_close"))
    w, session = Window.partitionBy(F.lit(0)).orderBy("day"), F.when(F.col("is_session"), F.col("day"))
    return days.select(
        "*",
        F.last(session, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("previous"),
        F.first(session, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
        F.last(session, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("latest"),
    )


def _utc(day: Column, clock: tuple[int, int]) -> Column:
    """UTC of a wall-clock time on a day, whatever the session's own zone."""
    wall = day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(clock[0]), mins=F.lit(clock[1]))
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), wall)


def session_bounds(days: DataFrame) -> DataFrame:
    """day, pre_start, open, close and post_end (UTC, TIMESTAMP_NTZ) of each session of a calendar."""
    d = F.col("day")
    close = F.when(F.col("early_close"), _utc(d, EARLY_CLOSE)).otherwise(_utc(d, CLOSE))
    return days.filter("is_session").select("day", _utc(d, PREMARKET).alias("pre_start"), _utc(d, OPEN).alias("open"), close.alias("close"), _utc(d, POSTMARKET_END).alias("post_end"))


def phase_bounds(events: DataFrame, days: DataFrame, date: str = "earnings_date") -> DataFrame:
    """events by phase with market_date, expected_start and expected_end.

    Events on a day without a session have no earnings phases; their following phases are the next session's.
    """
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(after).alias("after")) for p, (after, _, _) in PHASES.items()]))
    nxt = days.select(F.col("day").alias(date), "next")
    x = events.join(F.broadcast(nxt), date).select(*events.columns, "next", each.alias("p"))
    x = x.withColumn("market_date", F.when(F.col("p.after"), F.col("next")).otherwise(F.col(date)))
    x = x.join(F.broadcast(session_bounds(days).withColumnRenamed("day", "market_date")), "market_date")
    pick = lambda side: F.coalesce(*[F.when(F.col("p.phase") == p, F.col(v[side])) for p, v in PHASES.items()])
    return x.select(*events.columns, "p.phase", "market_date", pick(1).alias("expected_start"), pick(2).alias("expected_end"))
