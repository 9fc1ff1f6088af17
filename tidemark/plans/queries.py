"""Queries over the derived study inputs, each with SQL for the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..operators import bars as b
from ..operators import integrity, ledger, reaction, research, selection
from ..operators.reaction import HORIZONS, KEY
from ..sources import calendar as cal
from ..sources import fixtures as fx

#: Wall clock of the capture window, in minutes of the day (fixed values).
WINDOW_OPENS, WINDOW_ENDS = 15 * 60 + 50, 20 * 60 + 15

NOW = "2030-01-01 00:00:00"
COHORT = research.Cohort(directions=("up",), least_abs_return=1.0, most_delay=60, least_surprise=-50.0)
FLOOR = 50_000
#: In the middle of the tables, so that some captures are still to come.
QUALITY_NOW = "1998-01-01 20:10:00"
#: Every bound at once.
WIDE = research.Cohort(
    statuses=("complete",), classes=("immediate_continuation", "spike_and_fade", "delayed_breakout"), directions=("up", "down"), modes=("scheduled_capture",), least_abs_return=1.0, most_abs_return=3.0,
    least_retention=0.0, most_retention=1.2, least_delay=1, most_delay=60, least_volume=1000, least_coverage=0.95, least_surprise=-50.0, most_surprise=200.0,
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits: sums of doubles depend on their order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _features(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    return reaction.reaction_features(e, fx.unfolded(e))


def reaction_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_features(spark, d))


def _universe(spark: SparkSession, d: str) -> DataFrame:
    return research.universe(fx.events(spark, d), _features(spark, d))


def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    u = _universe(spark, d)
    return u.groupBy(F.coalesce("reaction_class", F.lit("not_analyzed")).alias("reaction_class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reaction_class")


def monthly_counts(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("reaction_class") != "insufficient_data"
    return _universe(spark, d).groupBy(F.date_format("earnings_date", "yyyy-MM").alias("month")).agg(F.count_if(done).alias("analyzed"), F.count("*").alias("total"))


def class_by_direction(spark: SparkSession, d: str) -> DataFrame:
    return _universe(spark, d).filter("direction IS NOT NULL").groupBy("reaction_class").pivot("direction", ["up", "down"]).count().na.fill(0)


def retention_histogram(spark: SparkSession, d: str) -> DataFrame:
    clipped = F.least(F.greatest("retention", F.lit(-2.0)), F.lit(3.0))
    place = F.least(F.floor((F.round(clipped, 6) + 2) / 0.125), F.lit(39)).cast("int")
    return _universe(spark, d).filter("retention IS NOT NULL").groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def liquidity_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.liquidity_quartiles(stored(_universe(spark, d).select("volume_105m", "retention"), "measures")))


def first_cross(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reaction.first_cross(fx.bars(fx.events(spark, d))))


def checkpoint_asof(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reaction.checkpoints(fx.bars(fx.events(spark, d))))


def vwap_proxy(spark: SparkSession, d: str) -> DataFrame:
    x = fx.bars(fx.events(spark, d)).groupBy(*KEY).agg(reaction.vwap(F.col("high"), F.col("low"), F.col("close"), F.col("volume"), F.col("phase") == "earnings_postmarket").alias("vwap"))
    return rounded(x)


def day_bars(spark: SparkSession, d: str) -> DataFrame:
    return b.minute_bars(fx.ticks(spark, d), "1 day")


def minute_bars(spark: SparkSession, d: str) -> DataFrame:
    return b.minute_bars(fx.ticks(spark, d))


def latest_quote(spark: SparkSession, d: str) -> DataFrame:
    t = b.latest_per_key(fx.ticks(spark, d), ["symbol"], F.col("received_at").desc(), F.col("event_id").desc())
    return t.select("symbol", "received_at", "last", "bid", "ask", "stale", "event_id")


def degradation_reasons(spark: SparkSession, d: str) -> DataFrame:
    t = b.latest_per_key(fx.ticks(spark, d), ["symbol"], F.col("received_at").desc(), F.col("event_id").desc())
    mid = F.when(F.col("ask").isNotNull(), (F.col("bid") + F.col("ask")) / 2)
    why = research.reasons((F.col("last").isNull(), "no_last_price"), (F.col("stale"), "stale_quote"), (F.col("ask").isNull(), "one_sided_quote"))
    spread = F.when(mid != 0, (F.col("ask") - F.col("bid")) / mid * 100)
    return rounded(t.select("symbol", mid.alias("mid"), spread.alias("spread_pct"), F.array_join(why, ",").alias("reasons")))


def changed_snapshots(spark: SparkSession, d: str) -> DataFrame:
    t = fx.ticks(spark, d)
    return b.changed_snapshots(t, ["symbol"], ["received_at", "event_id"], ["event_type", "stale"]).select("symbol", "event_id", "event_type", "stale")


def _retrievals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = fx.events(spark, d)
    first = F.col("earnings_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(21))
    x = fx.bars(e).withColumn("decoy", F.explode(F.array(F.lit(0), F.lit(1))))  # a union would lose that bars are dealt as their events are
    x = x.withColumns({"received_at": F.when(F.col("decoy") == 0, first).otherwise(first + F.expr("INTERVAL 1 HOUR")), "close": F.col("close") * (F.col("decoy") + 1)}).drop("decoy")
    start = F.col("earnings_date").cast("timestamp_ntz")
    cover = e.select(
        *KEY, F.lit("earnings_postmarket").alias("phase"), first.alias("received_at"),
        (start + F.make_dt_interval(hours=F.lit(16))).alias("expected_start"), (start + F.make_dt_interval(hours=F.lit(17))).alias("expected_end"),
    )
    return cover, x


def authoritative_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(b.authoritative_bars(*_retrievals(spark, d)).select(*KEY, "minute", "close", "volume"))


def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    expected = e.select(*KEY, F.lit("earnings_postmarket").alias("phase"), F.lit(105).alias("expected_minutes"))
    return rounded(b.coverage_summary(fx.bars(e), expected))


def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    seen = fx.bars(e).groupBy(*KEY, "phase").agg(F.count("*").alias("n"))
    phases = F.explode(F.array(*[F.lit(p) for p in ("earnings_regular", "earnings_postmarket", "following_premarket", "following_regular")]))
    return e.select(*KEY, phases.alias("phase")).join(seen, [*KEY, "phase"], "left").select(*KEY, "phase", F.when(F.col("n").isNull(), "MISSING").otherwise("PRESENT").alias("state"), F.coalesce("n", F.lit(0)).alias("bars"))


def cohort_page(spark: SparkSession, d: str) -> DataFrame:
    p = research.cohort_page(_universe(spark, d), COHORT, 50, 10)
    return rounded(p.select(*KEY, "reaction_class", "direction", "initial_return", "delay_minutes", "retention", "eps_surprise"))


def cohort_counts(spark: SparkSession, d: str) -> DataFrame:
    return research.cohort_counts(_universe(spark, d), COHORT)


def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _universe(spark, d).select(*KEY, F.array_join(COHORT.exclusions(), ",").alias("reasons"))


def exclusion_reasons_wide(spark: SparkSession, d: str) -> DataFrame:
    u = _universe(spark, d).withColumns({
        "analysis_status": F.when(F.col("reaction_class") == "insufficient_data", "insufficient_data").when(F.col("reaction_class").isNotNull(), "complete"),
        "collection_mode": F.when(F.col("backfilled"), "historical_backfill").otherwise("scheduled_capture"),
    })
    return u.select(*KEY, F.array_join(WIDE.exclusions(), ",").alias("reasons"))


def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    return research.quality_issues(_universe(spark, d), QUALITY_NOW)


def scatter_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_universe(spark, d).select("reaction_class", F.col("initial_return").alias("x"), F.col("return_105m").alias("y")).dropna())


def liquidity_floor(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d).select("symbol").distinct()
    j = e.join(ledger.liquidity(fx.daily_bars(spark, d)), "symbol", "left")
    keep = F.col("dollar_volume").isNull() | (F.col("dollar_volume") >= FLOOR)
    return rounded(j.select("symbol", "dollar_volume", keep.alias("keep")), 4)


def upsert_events(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    stored = e.filter("k % 3 <> 0").select(*KEY, "eps_estimate", F.lit(None).cast("double").alias("eps_actual"))
    new = e.filter("k % 3 <> 1").select(*KEY, (F.col("eps_estimate") + 1).alias("eps_estimate"), "eps_actual")
    return rounded(ledger.upsert_events(stored, new, list(KEY), ["eps_estimate"], ["eps_actual"]))


def append_only_new_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row is offered, some of them twice."""
    t = fx.ticks(spark, d).select("symbol", "received_at", "event_id")
    twice = t.unionByName(t.filter("event_id % 4 = 0"))
    return ledger.new_rows(t.filter("event_id % 3 = 0"), twice, ["event_id"]).select("event_id", "symbol")


def coverage_replace(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d).select(*KEY, "k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    mode = F.when((F.col("k") + F.col("n")) % 4 == 0, "historical_backfill").otherwise("scheduled_capture")
    return ledger.coverage_now(e.select(*KEY, mode.alias("mode"), F.col("n").alias("retrieved_at")), list(KEY))


def reconcile_plan(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    q = e.groupBy("symbol", "year", "quarter").agg(F.min("earnings_date").alias("d0"), F.min("k").alias("k0")).filter("(k0 div 5) % 6 <> 0")
    one = q.withColumn("date", F.expr("date_add(d0, CASE WHEN k0 % 3 = 0 THEN 7 ELSE 0 END)"))
    two = q.filter("k0 % 7 = 0").withColumn("date", F.expr("date_add(d0, 14)"))
    return ledger.reconcile_plan(e, one.unionByName(two).drop("d0", "k0"))


def monitor_health(spark: SparkSession, d: str) -> DataFrame:
    t = fx.ticks(spark, d)
    c = t.groupBy(F.window("event_timestamp", "5 minutes")["start"].alias("started")).agg(F.countDistinct("symbol").alias("candidates"), F.count("*").alias("fetched"), F.bool_or(F.col("event_type") == "error").alias("bad"))
    minute = F.hour("started") * 60 + F.minute("started")
    status = F.when(~minute.between(WINDOW_OPENS, WINDOW_ENDS), "inactive").when(F.col("bad"), "degraded").otherwise("success")
    c = c.withColumn("status", status).groupBy(F.to_date("started").alias("market_date"))
    ok = lambda s: F.max(F.when(F.col("status") == s, F.col("started")))
    return c.agg(F.max_by("status", "started").alias("last_status"), F.max_by("fetched", "started").alias("last_fetched"), ok("success").alias("last_success"), ok("degraded").alias("last_degraded"), F.sum("candidates").alias("candidates"))


def feature_violations(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    done: Column = F.col("reaction_class") != "insufficient_data"
    rules = research.reasons(
        (done & F.col("vwap").isNull(), "complete_without_vwap"), (~done & F.col("reason").isNull(), "insufficient_without_reason"),
        (F.col("mfe") < 0, "negative_mfe"), (F.col("mae") > 0, "positive_mae"), (F.col("observed_minutes") < 95, "thin_window"),
    )
    return f.select(*KEY, F.explode(rules).alias("rule"))


def daily_context(spark: SparkSession, d: str) -> DataFrame:
    return selection.daily_context(fx.events(spark, d), fx.daily_bars(spark, d)).select(*KEY, "rel", "session_date", F.round(F.col("close").cast("double") + 1e-7, 4).alias("close"), "volume")  # off the halves, which sums in another order may miss


def export_flatten(spark: SparkSession, d: str) -> DataFrame:
    u = _universe(spark, d)
    flags = research.reasons((F.col("stale"), "stale"), (F.col("early_close"), "early_close"), (F.col("backfilled"), "backfilled"))
    return u.select("symbol", F.date_format("earnings_date", "yyyy-MM-dd").alias("earnings_date"), F.array_join(flags, ";").alias("flags"), F.coalesce("reaction_class", F.lit("")).alias("reaction_class"))


def _calendar(spark: SparkSession, d: str) -> DataFrame:
    r = fx.read(spark, d, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")).first()
    return cal.calendar(spark, (r["a"] or 1992) - 1, (r["b"] or 1998) + 1)


def trading_days(spark: SparkSession, d: str) -> DataFrame:
    """Every order date: whether it is a session, and the sessions around it."""
    days = fx.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.join(F.broadcast(_calendar(spark, d)), "day")


def phase_bounds(spark: SparkSession, d: str) -> DataFrame:
    return cal.phase_bounds(fx.events(spark, d).select(*KEY), _calendar(spark, d))


def key_violations(spark: SparkSession, d: str) -> DataFrame:
    """Bars that share a key, and symbols with daily bars that no event has."""
    e = fx.events(spark, d)
    again = integrity.repeated_keys(fx.bars(e), [*KEY, "phase", "minute"]).select(F.lit("repeated_key").alias("rule"), "symbol", "earnings_date", "n")
    lost = integrity.orphans(fx.daily_bars(spark, d), e, ["symbol"])
    return again.unionByName(lost.select(F.lit("orphan").alias("rule"), "symbol", F.lit(None).cast("date").alias("earnings_date"), "n"))


def append_only_changes(spark: SparkSession, d: str) -> DataFrame:
    """Earlier rows that a later snapshot (some rows edited, some added) no longer holds."""
    e = fx.read(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    later = e.withColumn("event_type", F.when(F.col("event_id") % 97 == 0, F.lit("edited")).otherwise(F.col("event_type")))
    return integrity.changed_rows(e.filter("event_id % 5 <> 0"), later, ["day"]).select("event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        trading_days, phase_bounds, key_violations, append_only_changes,
        reaction_features, class_distribution, monthly_counts, class_by_direction, retention_histogram, liquidity_quartiles, first_cross, checkpoint_asof,
        vwap_proxy, day_bars, minute_bars, latest_quote, degradation_reasons, changed_snapshots, authoritative_bars, coverage_summary, coverage_audit,
        cohort_page, cohort_counts, exclusion_reasons, exclusion_reasons_wide, quality_issues, scatter_series, liquidity_floor, upsert_events, append_only_new_rows, coverage_replace,
        reconcile_plan, monitor_health, feature_violations, daily_context, export_flatten,
    )
}

# --- the same results in SQL ---

_IN = "phase = 'earnings_postmarket' AND minute BETWEEN 0 AND 104"
_SIGNAL = f"""
r AS (SELECT *, max(CASE WHEN phase = 'earnings_regular' AND minute = -1 THEN close END) OVER (PARTITION BY symbol, earnings_date) AS ref FROM bar),
c AS (SELECT *, CASE WHEN {_IN} THEN (close - ref) / nullif(ref, 0) * 100 END AS cr FROM r),
sg AS (SELECT *, min(CASE WHEN abs(cr) >= 2 THEN minute END) OVER (PARTITION BY symbol, earnings_date) AS trig FROM c),
sd AS (SELECT *, sign(max(CASE WHEN minute = trig THEN cr END) OVER (PARTITION BY symbol, earnings_date)) AS dir,
       (high - ref) / ref * 100 AS hr, (low - ref) / ref * 100 AS lr FROM sg)"""
_AT = ", ".join(
    f"max(minute) FILTER ({_IN} AND minute < {h}) AS at_{h}, arg_max(cr, minute) FILTER ({_IN} AND minute < {h}) AS r_{h}, sum(volume) FILTER ({_IN} AND minute < {h}) AS volume_{h}m"
    for h in HORIZONS
)
_RET = ", ".join(f"CASE WHEN at_{h} >= {h - 11} THEN r_{h} END AS return_{h}m" for h in HORIZONS)
_MISS = "list_filter([" + ", ".join(f"CASE WHEN return_{h}m IS NULL THEN '{h}m' END" for h in HORIZONS) + "], lambda x: x IS NOT NULL)"
_BAD = "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR low > least(open, close) OR high < greatest(open, close) OR high < low OR volume IS NULL OR volume < 0"
_FEATURES = f"""
ag AS (
  SELECT symbol, earnings_date, max(ref) AS pre_close, max(trig) AS trig, max(dir) AS dir, max(CASE WHEN minute = trig THEN cr END) AS initial_return,
    count(*) FILTER ({_IN}) AS post_bars, count(DISTINCT minute) FILTER ({_IN}) AS seen, count(*) FILTER (phase = 'earnings_regular') AS reg_bars,
    count(*) FILTER ({_BAD}) AS bad, max(hr) FILTER ({_IN}) AS high_return, min(lr) FILTER ({_IN}) AS low_return,
    sum((high + low + close) / 3 * volume) FILTER ({_IN} AND volume > 0) / nullif(sum(volume) FILTER ({_IN} AND volume > 0), 0) AS vwap,
    max(greatest(dir * hr, dir * lr)) FILTER ({_IN} AND minute > trig) AS best, min(least(dir * hr, dir * lr)) FILTER ({_IN} AND minute > trig) AS worst,
    count(*) FILTER ({_IN} AND minute > trig) AS later, arg_max(cr, minute) FILTER ({_IN}) AS terminal,
    coalesce(bool_or({_IN} AND minute >= trig AND cr >= 2), FALSE) AS up, coalesce(bool_or({_IN} AND minute >= trig AND cr <= -2), FALSE) AS down, {_AT}
  FROM sd GROUP BY symbol, earnings_date),
f0 AS (SELECT e.symbol, e.earnings_date, e.post_covered, e.stale, e.early_close, ag.* EXCLUDE (symbol, earnings_date), {_RET}
       FROM ev e LEFT JOIN ag ON e.symbol = ag.symbol AND e.earnings_date = ag.earnings_date),
f1 AS (SELECT *, CASE WHEN NOT post_covered THEN 'phase_not_covered' WHEN stale THEN 'stale_retrieval' WHEN early_close THEN 'early_close' WHEN bad > 0 THEN 'invalid_bar'
         WHEN post_bars > seen THEN 'duplicate_timestamp' WHEN coalesce(reg_bars, 0) = 0 THEN 'no_regular_bars' WHEN coalesce(post_bars, 0) < 5 THEN 'too_few_bars'
         WHEN pre_close IS NULL THEN 'reference_close_missing' END AS hard FROM f0),
f2 AS (SELECT *, coalesce(hard, CASE WHEN len({_MISS}) > 0 THEN 'no checkpoint bar within 10m for: ' || array_to_string({_MISS}, ', ') WHEN vwap IS NULL THEN 'vwap_missing' END,
         CASE WHEN trig IS NOT NULL AND later = 0 THEN 'trigger_on_last_bar' END) AS reason FROM f1),
f3 AS (SELECT *, reason IS NULL AND trig IS NOT NULL AS found, CASE WHEN reason IS NULL AND trig IS NOT NULL THEN greatest(0, dir * initial_return, best) END AS mfe,
         CASE WHEN reason IS NULL AND trig IS NOT NULL THEN least(0, dir * initial_return, worst) END AS mae FROM f2),
f4 AS (SELECT *, CASE WHEN mfe > 0 THEN greatest(0, (mfe - dir * terminal) / mfe * 100) END AS retracement FROM f3),
feat AS (
  SELECT symbol, earnings_date, CASE WHEN reason IS NOT NULL THEN 'insufficient_data' WHEN trig IS NULL THEN 'no_trigger_in_window' WHEN up AND down THEN 'whipsaw'
      WHEN retracement > 50 THEN 'spike_and_fade' WHEN trig + 1 >= 15 THEN 'delayed_breakout' ELSE 'immediate_continuation' END AS reaction_class, reason,
    CASE WHEN found THEN CASE WHEN dir > 0 THEN 'up' ELSE 'down' END END AS direction, CASE WHEN hard IS NULL THEN pre_close END AS pre_close,
    {", ".join(f"CASE WHEN hard IS NULL THEN return_{h}m END AS return_{h}m" for h in HORIZONS)},
    {", ".join(f"CAST(CASE WHEN hard IS NULL THEN volume_{h}m END AS BIGINT) AS volume_{h}m" for h in HORIZONS)},
    CASE WHEN hard IS NULL THEN high_return END AS high_return, CASE WHEN hard IS NULL THEN low_return END AS low_return, CASE WHEN hard IS NULL THEN vwap END AS vwap,
    CASE WHEN found THEN initial_return END AS initial_return, CASE WHEN found THEN trig + 1 END AS delay_minutes, mfe, mae, retracement, CAST(coalesce(seen, 0) AS INT) AS observed_minutes
  FROM f4)"""
_HEAD = f"WITH {fx.DUCK_EVENTS}, {fx.DUCK_BARS}, {_SIGNAL}, {_FEATURES}"
_U = f"""{_HEAD}, u AS (
  SELECT ev.*, feat.* EXCLUDE (symbol, earnings_date), CASE WHEN eps_estimate <> 0 THEN (eps_actual - eps_estimate) / abs(eps_estimate) * 100 END AS eps_surprise,
         CASE WHEN initial_return <> 0 THEN return_105m / initial_return END AS retention
  FROM ev LEFT JOIN feat ON ev.symbol = feat.symbol AND ev.earnings_date = feat.earnings_date WHERE hour = 'amc' AND NOT illiquid AND NOT superseded)"""
_ROUND = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
_NUM = [f"return_{h}m" for h in HORIZONS] + ["pre_close", "high_return", "low_return", "vwap", "initial_return", "mfe", "mae", "retracement"]
_X = ["direction = 'up'", "abs(initial_return) >= 1", "delay_minutes <= 60", "eps_surprise >= -50"]
_KEEP = " AND ".join(f"coalesce({x}, FALSE)" for x in _X)
_WHY = "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({x}, FALSE) THEN '{n}' END" for x, n in zip(_X, ["reaction_direction_excluded", "min_abs_initial_return_excluded", "max_detection_delay_excluded", "min_eps_surprise_pct_excluded"], strict=True))
_TICKS = f"WITH {fx.DUCK_TICKS}"
_BAR = lambda bucket: f"""{_TICKS}, t AS (SELECT *, time_bucket(INTERVAL '{bucket}', event_timestamp) AS bar_ts, row(event_timestamp, received_at, event_id) AS o FROM tick WHERE last IS NOT NULL)
SELECT symbol, bar_ts, arg_min(last, o) AS open, max(last) AS high, min(last) AS low, arg_max(last, o) AS close,
  CASE WHEN arg_max(volume, o) >= arg_min(volume, o) THEN arg_max(volume, o) - arg_min(volume, o) END AS volume, count(*) AS ticks FROM t GROUP BY ALL"""  # noqa: E731
_LATEST = f"{_TICKS}, q AS (SELECT * FROM tick QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY received_at DESC, event_id DESC) = 1)"

#: Good Fridays, as given dates; they must cover the tables' years and one on each side.
_GOOD_FRIDAYS = (
    "1991-03-29", "1992-04-17", "1993-04-09", "1994-04-01", "1995-04-14", "1996-04-05", "1997-03-28", "1998-04-10", "1999-04-02",
    "2000-04-21", "2001-04-13", "2002-03-29", "2003-04-18", "2004-04-09", "2005-03-25",
)
_NTH = "SELECT d + CAST((7 + {dow} - isodow(d)) % 7 AS INT) + {skip} FROM (SELECT make_date(y, {month}, 1) AS d FROM yr{when})"
_CAL = f"""yr AS (SELECT CAST(unnest(range((SELECT min(year(o_orderdate)) FROM orders) - 1, (SELECT max(year(o_orderdate)) FROM orders) + 2)) AS INT) AS y),
thanks AS ({_NTH.format(dow=4, skip=21, month=11, when="").replace(" FROM (", " AS d FROM (", 1)}),
hol(d) AS (SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END FROM (SELECT make_date(y, 7, 4) AS d FROM yr UNION ALL SELECT make_date(y, 12, 25) FROM yr)
  UNION ALL SELECT CASE isodow(d) WHEN 7 THEN d + 1 ELSE d END FROM (SELECT make_date(y, 1, 1) AS d FROM yr)
  UNION ALL {_NTH.format(dow=1, skip=14, month=2, when="")} UNION ALL {_NTH.format(dow=1, skip=14, month=1, when=" WHERE y >= 1998")} UNION ALL {_NTH.format(dow=1, skip=0, month=9, when="")}
  UNION ALL SELECT d FROM thanks UNION ALL SELECT d - CAST(isodow(d) - 1 AS INT) FROM (SELECT make_date(y, 5, 31) AS d FROM yr)
  UNION ALL SELECT CAST(unnest({list(_GOOD_FRIDAYS)}) AS DATE)),
day0 AS (SELECT CAST(unnest(range(make_date((SELECT min(y) FROM yr), 1, 1), make_date((SELECT max(y) FROM yr) + 1, 1, 1), INTERVAL 1 DAY)) AS DATE) AS day),
day1 AS (SELECT day, isodow(day) < 6 AND day NOT IN (SELECT d FROM hol) AS is_session FROM day0),
day2 AS (SELECT *, is_session AND (day IN (SELECT d + 1 FROM thanks) OR strftime(day, '%m-%d') = '12-24' OR (strftime(day, '%m-%d') = '07-03' AND isodow(day) < 5)) AS early_close,
  CASE WHEN is_session THEN day END AS s FROM day1),
cal AS (SELECT day, is_session, early_close, max(s) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
  min(s) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next, max(s) OVER (ORDER BY day) AS latest FROM day2)"""
#: Hours that New York was behind UTC in these years: daylight time from the first Sunday of April to the last of October.
_BEHIND = """CASE WHEN market_date >= make_date(year(market_date), 4, 1) + CAST((7 - isodow(make_date(year(market_date), 4, 1))) AS INT)
  AND market_date < make_date(year(market_date), 10, 31) - CAST(isodow(make_date(year(market_date), 10, 31)) % 7 AS INT) THEN 4 ELSE 5 END"""

ORACLE_SQL = {
    "trading_days": f"WITH {_CAL} SELECT * FROM cal WHERE day IN (SELECT CAST(o_orderdate AS DATE) FROM orders)",
    "phase_bounds": f"""WITH {fx.DUCK_EVENTS}, {_CAL}, ph AS (SELECT symbol, earnings_date, phase, CASE WHEN phase LIKE 'following%' THEN next ELSE earnings_date END AS market_date
  FROM ev JOIN cal ON day = earnings_date, (VALUES ('earnings_regular'), ('earnings_postmarket'), ('following_premarket'), ('following_regular')) v(phase)),
pb AS (SELECT ph.*, {_BEHIND} * 60 AS z, CASE WHEN early_close THEN 780 ELSE 960 END AS shut FROM ph JOIN cal ON day = market_date WHERE is_session)
SELECT symbol, earnings_date, phase, market_date,
CAST(market_date AS TIMESTAMP) + (z + CASE phase WHEN 'earnings_postmarket' THEN shut WHEN 'following_premarket' THEN 420 ELSE 570 END) * INTERVAL 1 MINUTE AS expected_start,
CAST(market_date AS TIMESTAMP) + (z + CASE phase WHEN 'earnings_postmarket' THEN 1200 WHEN 'following_premarket' THEN 570 ELSE shut END) * INTERVAL 1 MINUTE AS expected_end FROM pb""",
    "key_violations": f"""WITH {fx.DUCK_EVENTS}, {fx.DUCK_BARS}, {fx.DUCK_DAILY}
SELECT 'repeated_key' AS rule, symbol, earnings_date, count(*) AS n FROM bar GROUP BY symbol, earnings_date, phase, minute HAVING count(*) > 1
UNION ALL SELECT 'orphan', symbol, NULL, count(*) FROM daily WHERE symbol NOT IN (SELECT symbol FROM ev) GROUP BY symbol""",
    "append_only_changes": "SELECT event_id, event_type FROM events WHERE event_id % 5 <> 0 AND event_id % 97 = 0 AND event_type <> 'edited'",
    "reaction_features": f"{_HEAD} SELECT symbol, earnings_date, reaction_class, reason, direction, delay_minutes, observed_minutes, {', '.join(f'volume_{h}m' for h in HORIZONS)}, {_ROUND(_NUM)} FROM feat",
    "class_distribution": f"{_U} SELECT coalesce(reaction_class, 'not_analyzed') AS reaction_class, count(*) AS n FROM u GROUP BY ALL",
    "monthly_counts": f"{_U} SELECT strftime(earnings_date, '%Y-%m') AS month, count(*) FILTER (reaction_class <> 'insufficient_data') AS analyzed, count(*) AS total FROM u GROUP BY ALL",
    "class_by_direction": f"{_U} SELECT reaction_class, count(*) FILTER (direction = 'up') AS up, count(*) FILTER (direction = 'down') AS down FROM u WHERE direction IS NOT NULL GROUP BY ALL",
    "retention_histogram": f"{_U} SELECT CAST(least(floor((round(least(greatest(retention, -2), 3), 6) + 2) / 0.125), 39) AS INT) AS bin, count(*) AS n FROM u WHERE retention IS NOT NULL GROUP BY ALL",
    "liquidity_quartiles": f"""{_U}, e AS (SELECT quantile_cont(volume_105m, [0.25, 0.5, 0.75]) AS e FROM u)
SELECT CAST(1 + (volume_105m > e[1])::INT + (volume_105m > e[2])::INT + (volume_105m > e[3])::INT AS INT) AS bucket, count(*) AS n, round(quantile_cont(retention, 0.5), 6) AS median_retention
FROM u, e WHERE volume_105m IS NOT NULL GROUP BY ALL""",
    "first_cross": f"""WITH {fx.DUCK_EVENTS}, {fx.DUCK_BARS}, {_SIGNAL} SELECT symbol, earnings_date, min(trig) AS trigger_minute, min(trig) + 1 AS signal_minute,
round(max(CASE WHEN minute = trig THEN cr END), 6) AS initial_return FROM sg WHERE {_IN} GROUP BY ALL""",
    "checkpoint_asof": f"""WITH {fx.DUCK_EVENTS}, {fx.DUCK_BARS}, h AS (SELECT unnest([1, 5, 15, 30, 60, 105]) AS horizon),
k AS (SELECT DISTINCT symbol, earnings_date FROM bar WHERE {_IN}),
x AS (SELECT k.symbol, k.earnings_date, horizon, arg_max(close, minute) AS close, horizon - 1 - max(minute) AS age FROM k CROSS JOIN h
      LEFT JOIN bar b ON b.symbol = k.symbol AND b.earnings_date = k.earnings_date AND {_IN} AND minute < horizon GROUP BY k.symbol, k.earnings_date, horizon)
SELECT symbol, earnings_date, CAST(horizon AS INT) AS horizon, CASE WHEN age <= 10 THEN round(close, 6) END AS close, CAST(CASE WHEN age <= 10 THEN age END AS INT) AS age, coalesce(age <= 10, FALSE) AS usable FROM x""",
    "vwap_proxy": f"""WITH {fx.DUCK_EVENTS}, {fx.DUCK_BARS} SELECT symbol, earnings_date,
round(sum((high + low + close) / 3 * volume) FILTER (phase = 'earnings_postmarket' AND volume > 0) / nullif(sum(volume) FILTER (phase = 'earnings_postmarket' AND volume > 0), 0), 6) AS vwap FROM bar GROUP BY ALL""",
    "day_bars": _BAR("1 day"),
    "minute_bars": _BAR("1 minute"),
    "latest_quote": f"{_LATEST} SELECT symbol, received_at, last, bid, ask, stale, event_id FROM q",
    "degradation_reasons": f"""{_LATEST} SELECT symbol, round((bid + ask) / 2, 6) AS mid, round((ask - bid) / nullif((bid + ask) / 2, 0) * 100, 6) AS spread_pct,
array_to_string(list_filter([CASE WHEN last IS NULL THEN 'no_last_price' END, CASE WHEN stale THEN 'stale_quote' END, CASE WHEN ask IS NULL THEN 'one_sided_quote' END], lambda x: x IS NOT NULL), ',') AS reasons FROM q""",
    "changed_snapshots": f"""{_TICKS}, l AS (SELECT *, lag(event_type || stale) OVER w AS p FROM tick WINDOW w AS (PARTITION BY symbol ORDER BY received_at, event_id))
SELECT symbol, event_id, event_type, stale FROM l WHERE p IS NULL OR p <> event_type || stale""",
    "authoritative_bars": f"WITH {fx.DUCK_EVENTS}, {fx.DUCK_BARS} SELECT symbol, earnings_date, minute, round(close, 6) AS close, volume FROM bar WHERE phase = 'earnings_postmarket' AND minute < 60 AND id = 0",
    "coverage_summary": f"""WITH {fx.DUCK_EVENTS}, {fx.DUCK_BARS}, g AS (SELECT symbol, earnings_date, min(minute) AS first_minute, max(minute) AS last_minute, count(DISTINCT minute) AS seen, count(*) AS n FROM bar WHERE phase = 'earnings_postmarket' GROUP BY ALL)
SELECT ev.symbol, ev.earnings_date, 'earnings_postmarket' AS phase, first_minute, last_minute, CAST(coalesce(seen, 0) AS INT) AS observed, CAST(105 - coalesce(seen, 0) AS INT) AS missing, round(coalesce(seen, 0) / 105, 6) AS ratio,
CASE WHEN seen IS NULL THEN 'no_bars_in_requested_phase' WHEN n > seen THEN 'duplicate_minute_bars' ELSE '' END AS flags FROM ev LEFT JOIN g ON ev.symbol = g.symbol AND ev.earnings_date = g.earnings_date""",
    "coverage_audit": f"""WITH {fx.DUCK_EVENTS}, {fx.DUCK_BARS}, g AS (SELECT symbol, earnings_date, phase, count(*) AS n FROM bar GROUP BY ALL), p AS (SELECT unnest(['earnings_regular', 'earnings_postmarket', 'following_premarket', 'following_regular']) AS phase)
SELECT ev.symbol, ev.earnings_date, p.phase, CASE WHEN n IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS state, coalesce(n, 0) AS bars FROM ev CROSS JOIN p LEFT JOIN g ON ev.symbol = g.symbol AND ev.earnings_date = g.earnings_date AND p.phase = g.phase""",
    "cohort_page": f"""{_U} SELECT symbol, earnings_date, reaction_class, direction, round(initial_return, 6) AS initial_return, delay_minutes, round(retention, 6) AS retention, round(eps_surprise, 6) AS eps_surprise
FROM u WHERE {_KEEP} ORDER BY abs(u.initial_return) DESC NULLS LAST, u.earnings_date DESC, symbol LIMIT 50 OFFSET 10""",
    "cohort_counts": f"{_U} SELECT coalesce(reaction_class, 'not_analyzed') AS status, count(*) AS universe, count(*) FILTER ({_KEEP}) AS included, count(*) FILTER (NOT ({_KEEP})) AS excluded FROM u GROUP BY ALL",
    "exclusion_reasons": f"{_U} SELECT symbol, earnings_date, array_to_string({_WHY}], lambda x: x IS NOT NULL), ',') AS reasons FROM u",
    "exclusion_reasons_wide": f"""{_U} SELECT symbol, earnings_date, array_to_string(list_filter([
  CASE WHEN NOT coalesce(reaction_class <> 'insufficient_data', FALSE) THEN 'analysis_status_excluded' END,
  CASE WHEN NOT coalesce(reaction_class IN ('immediate_continuation', 'spike_and_fade', 'delayed_breakout'), FALSE) THEN 'reaction_class_excluded' END,
  CASE WHEN direction IS NULL THEN 'reaction_direction_excluded' END, CASE WHEN backfilled THEN 'postmarket_collection_mode_excluded' END,
  CASE WHEN NOT coalesce(abs(initial_return) >= 1, FALSE) THEN 'min_abs_initial_return_excluded' END, CASE WHEN NOT coalesce(abs(initial_return) <= 3, FALSE) THEN 'max_abs_initial_return_excluded' END,
  CASE WHEN NOT coalesce(retention >= 0, FALSE) THEN 'min_retention_excluded' END, CASE WHEN NOT coalesce(retention <= 12e-1, FALSE) THEN 'max_retention_excluded' END,
  CASE WHEN NOT coalesce(delay_minutes >= 1, FALSE) THEN 'min_detection_delay_excluded' END, CASE WHEN NOT coalesce(delay_minutes <= 60, FALSE) THEN 'max_detection_delay_excluded' END,
  CASE WHEN NOT coalesce(volume_105m >= 1000, FALSE) THEN 'min_volume_105m_excluded' END, CASE WHEN NOT coalesce(observed_minutes / 105 >= 95e-2, FALSE) THEN 'min_coverage_ratio_excluded' END,
  CASE WHEN NOT coalesce(eps_surprise >= -50, FALSE) THEN 'min_eps_surprise_pct_excluded' END, CASE WHEN NOT coalesce(eps_surprise <= 200, FALSE) THEN 'max_eps_surprise_pct_excluded' END
], lambda x: x IS NOT NULL), ',') AS reasons FROM u""",
    "quality_issues": f"""{_U}, k AS (SELECT *, CASE WHEN NOT post_covered THEN CASE WHEN earnings_date + INTERVAL 1210 MINUTE <= TIMESTAMP '{QUALITY_NOW}' THEN 'missing_capture_phase' END WHEN reaction_class IS NULL THEN 'not_analyzed' WHEN reaction_class = 'insufficient_data' THEN 'insufficient_data'
WHEN backfilled THEN 'historical_backfill' WHEN observed_minutes < 105 THEN 'data_quality_flag' END AS kind FROM u) SELECT symbol, earnings_date, kind, CASE WHEN kind = 'insufficient_data' THEN reason END AS detail FROM k WHERE kind IS NOT NULL""",
    "scatter_series": f"{_U} SELECT reaction_class, round(initial_return, 6) AS x, round(return_105m, 6) AS y FROM u WHERE reaction_class IS NOT NULL AND initial_return IS NOT NULL AND return_105m IS NOT NULL",
    "liquidity_floor": f"""WITH {fx.DUCK_EVENTS}, {fx.DUCK_DAILY}, t AS (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) <= 10),
l AS (SELECT symbol, avg(close * volume) AS dv FROM t GROUP BY ALL) SELECT s.symbol, round(dv, 4) AS dollar_volume, dv IS NULL OR dv >= {FLOOR} AS keep FROM (SELECT DISTINCT symbol FROM ev) s LEFT JOIN l ON s.symbol = l.symbol""",
    "upsert_events": f"""WITH {fx.DUCK_EVENTS} SELECT symbol, earnings_date, round(CASE WHEN k % 3 <> 0 THEN coalesce(eps_estimate, CASE WHEN k % 3 <> 1 THEN eps_estimate + 1 END) ELSE eps_estimate + 1 END, 6) AS eps_estimate,
round(CASE WHEN k % 3 <> 1 THEN eps_actual END, 6) AS eps_actual, k % 3 = 0 AS is_new FROM ev""",
    "append_only_new_rows": "SELECT event_id, 'U' || user_id AS symbol FROM events WHERE event_id % 3 <> 0",
    "coverage_replace": f"""WITH {fx.DUCK_EVENTS}, a AS (SELECT symbol, earnings_date, CASE WHEN (k + n) % 4 = 0 THEN 'historical_backfill' ELSE 'scheduled_capture' END AS mode, CAST(n AS INT) AS retrieved_at FROM ev, range(3) r(n))
SELECT symbol, earnings_date, CASE WHEN arg_min(mode, retrieved_at) = 'historical_backfill' THEN 'historical_backfill' ELSE 'scheduled_capture' END AS mode,
CASE WHEN arg_min(mode, retrieved_at) = 'historical_backfill' THEN min(retrieved_at) ELSE max(retrieved_at) FILTER (mode = 'scheduled_capture') END AS retrieved_at FROM a GROUP BY ALL""",
    "reconcile_plan": f"""WITH {fx.DUCK_EVENTS}, q AS (SELECT symbol, year, quarter, min(earnings_date) AS d0, min(k) AS k0 FROM ev GROUP BY ALL HAVING (min(k) // 5) % 6 <> 0),
li AS (SELECT symbol, year, quarter, d0 + CASE WHEN k0 % 3 = 0 THEN 7 ELSE 0 END AS d FROM q UNION ALL SELECT symbol, year, quarter, d0 + 14 FROM q WHERE k0 % 7 = 0),
s AS (SELECT symbol, year, quarter, min(d) AS listed FROM li GROUP BY ALL HAVING min(d) = max(d)),
x AS (SELECT ev.symbol, earnings_date, listed, ev.year, ev.quarter, CASE WHEN listed <> earnings_date AND NOT superseded THEN 'supersede' WHEN listed = earnings_date AND superseded THEN 'reinstate' END AS action FROM ev JOIN s ON ev.symbol = s.symbol AND ev.year = s.year AND ev.quarter = s.quarter)
SELECT symbol, earnings_date, action, CAST(listed AS DATE) AS listed, CASE WHEN action = 'supersede' THEN 'Q' || quarter || ' of ' || year || ' is listed on ' || strftime(listed, '%Y-%m-%d') END AS reason FROM x WHERE action IS NOT NULL""",
    "monitor_health": f"""{_TICKS}, c AS (SELECT time_bucket(INTERVAL '5 minutes', event_timestamp) AS started, count(DISTINCT symbol) AS candidates, count(*) AS fetched, bool_or(event_type = 'error') AS bad FROM tick GROUP BY ALL),
s AS (SELECT *, CASE WHEN strftime(started, '%H:%M') NOT BETWEEN '15:50' AND '20:15' THEN 'inactive' WHEN bad THEN 'degraded' ELSE 'success' END AS status FROM c)
SELECT CAST(started AS DATE) AS market_date, arg_max(status, started) AS last_status, arg_max(fetched, started) AS last_fetched, max(started) FILTER (status = 'success') AS last_success,
max(started) FILTER (status = 'degraded') AS last_degraded, CAST(sum(candidates) AS BIGINT) AS candidates FROM s GROUP BY ALL""",
    "feature_violations": f"""{_HEAD} SELECT symbol, earnings_date, unnest(list_filter([CASE WHEN reaction_class <> 'insufficient_data' AND vwap IS NULL THEN 'complete_without_vwap' END,
CASE WHEN reaction_class = 'insufficient_data' AND reason IS NULL THEN 'insufficient_without_reason' END, CASE WHEN mfe < 0 THEN 'negative_mfe' END, CASE WHEN mae > 0 THEN 'positive_mae' END,
CASE WHEN observed_minutes < 95 THEN 'thin_window' END], lambda x: x IS NOT NULL)) AS rule FROM feat""",
    "daily_context": f"""WITH {fx.DUCK_EVENTS}, {fx.DUCK_DAILY}, d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date) AS n FROM daily),
a AS (SELECT ev.symbol, earnings_date, coalesce(min(n) FILTER (session_date >= earnings_date), max(n)) AS n0 FROM ev JOIN d ON ev.symbol = d.symbol GROUP BY ALL),
w AS (SELECT symbol, earnings_date, n0, unnest(range(n0 - 120, n0 + 31)) AS n FROM a)
SELECT w.symbol, earnings_date, CAST(w.n - n0 AS INT) AS rel, session_date, round(CAST(close AS DOUBLE) + 1e-7, 4) AS close, volume FROM w JOIN d ON w.symbol = d.symbol AND w.n = d.n""",
    "export_flatten": f"""{_U} SELECT symbol, strftime(earnings_date, '%Y-%m-%d') AS earnings_date, array_to_string(list_filter([CASE WHEN stale THEN 'stale' END, CASE WHEN early_close THEN 'early_close' END,
CASE WHEN backfilled THEN 'backfilled' END], lambda x: x IS NOT NULL), ';') AS flags, coalesce(reaction_class, '') AS reaction_class FROM u""",
}
