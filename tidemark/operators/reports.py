"""Shapes for pages and charts: paths with their checkpoints, price levels, series, disclosures and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pct_change
from .evidence import PHASES, minutes_of
from .reaction import HORIZONS, KEY, MOST_CARRY, THRESHOLD_PCT, Bars

#: Caps of reads (fixed values): quality issues, rows of a chart, rows of an export; days of a bare page.
MOST_ISSUES, MOST_CHART_ROWS, MOST_EXPORT_ROWS, DEFAULT_DAYS = 500, 2_000, 5_000, 180


def coverage_audit(events: DataFrame, coverage: DataFrame) -> DataFrame:
    """A row for each after-close event and phase, covered or not: state PRESENT or MISSING, and what the coverage row says (minutes, retrieval, mode, flags)."""
    each = events.filter("hour = 'amc'").select(*KEY, F.explode(F.array(*[F.lit(p) for p in PHASES])).alias("phase"))
    c = coverage.select(*KEY, "phase", "market_date", "session", "expected_start", "expected_end", "observed_minutes", "expected_minutes", "received_at", "response_sha256", "collection_mode", "data_quality_flags", F.lit(True).alias("_there"))
    return each.join(c, [*KEY, "phase"], "left").withColumn("state", F.when(F.col("_there"), "PRESENT").otherwise("MISSING")).drop("_there")


def newest(rows: DataFrame, most: int) -> DataFrame:
    """The newest events' rows, `most` at most: what a chart (MOST_CHART_ROWS) or an export (MOST_EXPORT_ROWS) reads."""
    return rows.orderBy(F.desc("earnings_date"), "symbol").limit(most)


def with_values(bars: Bars, found: DataFrame, rows: DataFrame) -> DataFrame:
    """Bars with what was found of their event and its stored row's reference price. Bars that are unfolded are unfolded beside these values: none is sorted for a join."""
    values = found.join(rows.select(*KEY, "reference_price"), list(KEY), "full")
    return bars(values) if callable(bars) else bars.join(values, list(KEY), "left")


def path_bars(bars: Bars, rows: DataFrame) -> DataFrame:
    """Bars of all phases of each event, each with its change from the reference price and the horizons that it stands for.

    bars: evidence.first_of_each(phase_bars()), as rows or unfolded; rows: stored feature rows. Horizons read the latest postmarket bar at or before them, MOST_CARRY minutes old at most."""
    post = F.col("phase") == "earnings_postmarket"
    early = minutes_of(bars(None, (F.lit(0), F.lit(HORIZONS[-1] - 1))) if callable(bars) else bars).filter(post)
    last = early.groupBy(*KEY).agg(*[F.max(F.when(F.col("minute") < h, F.col("minute"))).alias(f"_{h}") for h in HORIZONS])
    b = minutes_of(with_values(bars, last, rows))
    at = [F.when(post & (F.col("minute") == F.col(f"_{h}")) & (F.col("minute") >= h - 1 - MOST_CARRY), F.lit(f"{h}m")) for h in HORIZONS]
    change = pct_change(F.col("reference_price"), F.col("close"))
    return b.select(*KEY, "phase", "ts", "open", "high", "low", "close", "volume", change.alias("change"), F.array_compact(F.array(*at)).alias("checkpoints"))


def event_paths(bars: Bars, rows: DataFrame) -> DataFrame:
    """path_bars() with their place in the order of time and phase."""
    b = path_bars(bars, rows)
    return b.select(*KEY, F.row_number().over(Window.partitionBy(*KEY).orderBy("ts", "phase")).alias("place"), *b.columns[len(KEY) :])


def following_path(bars: Bars, rows: DataFrame) -> DataFrame:
    """Bars of the day after each event, in order, with the reference price; `mark` names the regular session's first and last bar."""
    reg = F.col("phase") == "following_regular"
    ends = (bars(None) if callable(bars) else bars).filter(reg).groupBy(*KEY).agg(F.min("ts").alias("_a"), F.max("ts").alias("_z"))
    mark = F.when(reg & (F.col("ts") == F.col("_a")), "open").when(reg & (F.col("ts") == F.col("_z")), "close")
    b = with_values(bars, ends, rows).filter(F.col("phase").isin("following_premarket", "following_regular"))
    return b.select(*KEY, "phase", "ts", "close", "reference_price", mark.alias("mark"))


def path_levels(rows: DataFrame, threshold: float = THRESHOLD_PCT) -> DataFrame:
    """Price levels of each stored row with a reference: the band of the threshold, the excursions on the side of the signal, the average price."""
    ref, way = F.col("reference_price"), F.when(F.col("reaction_direction") == "up", 1.0).otherwise(-1.0)
    level = lambda pct: ref * (1 + pct / 100)
    r = rows.filter("reference_price IS NOT NULL")
    return r.select(
        *KEY, ref.alias("reference"), level(F.lit(threshold)).alias("upper"), level(F.lit(-threshold)).alias("lower"), level(way * F.col("max_favorable_excursion")).alias("mfe_level"),
        level(way * F.col("max_adverse_excursion")).alias("mae_level"), F.col("reaction_vwap_proxy").alias("vwap"), "reaction_timestamp", "feature_cutoff_ts",
    )


#: Series of scatter charts: x and y (fixed values).
SERIES = {"initial_vs_final": ("initial_return", "return_105m"), "delay_vs_retention": ("detection_delay_minutes", "retention"), "surprise_vs_reaction": ("eps_surprise_pct", "initial_return")}


def scatter_series(u: DataFrame) -> DataFrame:
    """Points of every series by class; a point with a null side is left out. One pass over the universe."""
    points = F.array(*[F.struct(F.lit(n).alias("series"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for n, (x, y) in SERIES.items()])
    return u.select(*KEY, F.coalesce("reaction_class", F.lit("not_analyzed")).alias("reaction_class"), F.explode(points).alias("p")).select(*KEY, "reaction_class", "p.*").dropna(subset=["x", "y"])


def monthly_series(u: DataFrame) -> DataFrame:
    """Complete and other events by month."""
    done = F.coalesce(F.col("analysis_status") == "complete", F.lit(False))
    return u.groupBy(F.date_format("earnings_date", "yyyy-MM").alias("month")).agg(F.count_if(done).alias("complete"), F.count_if(~done).alias("not_complete"))


def disclosure(u: DataFrame, keeps: Column, limit: int, offset: int = 0) -> DataFrame:
    """One row: universe, included and excluded events, the excluded by status, the rows of the page and whether rows are left after or before it."""
    status = F.coalesce("analysis_status", F.lit("not_analyzed"))
    s = u.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.count_if(keeps).alias("inside"))
    out = F.filter(F.array_sort(F.collect_list(F.struct("status", (F.col("n") - F.col("inside")).alias("n")))), lambda x: x["n"] > 0)  # a few statuses
    r = s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("universe_count"), F.coalesce(F.sum("inside"), F.lit(0)).alias("included_count"), F.to_json(F.map_from_entries(out)).alias("excluded_by_status"))
    page = F.greatest(F.least(F.col("included_count") - offset, F.lit(limit)), F.lit(0))
    return r.select("universe_count", "included_count", (F.col("universe_count") - F.col("included_count")).alias("excluded_count"), "excluded_by_status", page.alias("page_count"), (page < F.col("included_count")).alias("truncated"))


def trailing(events: DataFrame, as_of: str, days: int = DEFAULT_DAYS) -> DataFrame:
    """Events of the last days up to as_of: what a page shows that names no bound."""
    end = F.lit(as_of).cast("date")
    return events.filter(F.col("earnings_date").between(F.date_sub(end, days), end))


def value_counts(u: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (null: none), n and its share of all rows, for each of the columns; one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns]))
    g = u.select(each.alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column")))


def issues_by_kind(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind").agg(F.count("*").alias("n"), F.min("earnings_date").alias("first"), F.max("earnings_date").alias("last"))


def first_issues(issues: DataFrame, most: int = MOST_ISSUES) -> DataFrame:
    """The newest issues, a page's worth: sorted and cut in one step, so no task sorts them all."""
    return newest(issues, most)


def event_detail(keys: DataFrame, u: DataFrame, coverage: DataFrame, bars: Bars, notes: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """Everything about any number of events (symbol, earnings_date), each frame in its order: summary, coverage by start, bars by time and phase,
    notes from the newest, parameters of the stored row. Of bars that are unfolded only these events' are: the few keys are joined, not the bars."""
    k = keys.select(*KEY).distinct()
    of = lambda df: df.join(k, list(KEY), "left_semi")
    own = bars(k.withColumn("_own", F.lit(True))).filter("_own").drop("_own") if callable(bars) else of(bars)
    return {
        "summary": of(u), "coverage": of(coverage).orderBy(*KEY, "expected_start"), "bars": own.orderBy(*KEY, "ts", "phase"), "notes": of(notes).orderBy(*KEY, F.desc("created_at")),
        "parameters": of(rows).select(*KEY, "parameters"),
    }


def first_listed(entries: DataFrame, order: str) -> DataFrame:
    """After-close entries, of each symbol and date the first by `order`."""
    w = Window.partitionBy("symbol", "date").orderBy(order)
    return entries.filter("hour = 'amc'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def age_seconds(at: Column, now: str) -> Column:
    """Whole seconds from a time to now (text), null for no time."""
    return F.timestamp_diff("SECOND", at, F.lit(now).cast("timestamp_ntz"))


def stale_watchlists(lists: DataFrame, days: DataFrame, today: str) -> DataFrame:
    """lists (as_of) with the latest session of today and whether they were written before it; without an as_of they are stale.

    days: the calendar, of which one row is used."""
    latest = days.filter(F.col("day") == F.lit(today).cast("date")).select(F.col("latest").alias("latest_session"))
    return lists.crossJoin(F.broadcast(latest)).withColumn("stale", F.coalesce(F.col("as_of") < F.col("latest_session"), F.lit(True)))  # one row
