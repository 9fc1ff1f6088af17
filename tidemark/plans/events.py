"""Queries over coverage rows and authoritative bars: stored features and outcomes, universe, studies, reconciliation and reports, each with SQL for the same result."""

from __future__ import annotations

from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import eastern, norm_symbol, only_finite, row_digest
from ..functions.tables import stored
from ..operators import asof, ledger, ranks, reports, selection, study
from ..operators import evidence as ev
from ..operators import outcome as oc
from ..operators.reaction import HORIZONS, KEY, Bars
from ..sources import calendar as cal
from ..sources import evidence as evx
from ..sources import exports
from ..sources import fixtures as fx
from . import queries as core
from .queries import rounded

#: In the middle of the tables, at a time at which some captures and sessions are still to come.
NOW = "1998-01-02 14:05:00"
WINDOW = ("1995-01-01", "1996-12-31")


class Inputs:
    """The derived tables of one folder. Stored feature rows and outcomes are derived when a query first asks for them and written to the shared folder,
    so that executors keep nothing and queries read the columns they need. Events are dealt once a query by their key; coverage and bars, hundreds an
    event, are made of them in place, so that no bar is written, and none is shuffled on that key."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    @cached_property
    def events(self) -> DataFrame:
        return fx.events(self.spark, self.d, fx.EVENTS_PER_TEXTS_PART)

    @cached_property
    def days(self) -> DataFrame:
        return core._calendar(self.spark, self.d)

    @cached_property
    def coverage(self) -> DataFrame:
        return evx.coverage(self.events, self.days)

    def unfolded(self, *phases: str) -> Bars:
        return evx.unfolded(self.events, self.days, phases or ev.PHASES)

    def first(self, *phases: str) -> Bars:
        """unfolded(), of the bars of one time the first."""
        return partial(self.unfolded(*phases), first=True)

    @cached_property
    def bars(self) -> DataFrame:
        return self.unfolded()(None)

    @cached_property
    def notes(self) -> DataFrame:
        return evx.notes(self.events)

    @cached_property
    def features(self) -> DataFrame:
        header = ev.evidence_header(self.events, self.coverage)
        bars = self.unfolded(*ev.STUDY_PHASES)
        return ev.evidence_features(ev.evidence_digests(header, bars), bars)

    @cached_property
    def rows(self) -> DataFrame:
        return stored(ev.feature_rows(self.features), "feature_rows")

    @cached_property
    def ledger(self) -> DataFrame:
        """Rows as a ledger has them: some events twice, of two versions, some retracted, some not analyzed."""
        rows = self.rows.filter("day(earnings_date) <> 3").withColumn("computed_at", F.col("earnings_date").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(1)))
        old = rows.filter("day(earnings_date) < 10").withColumns({"feature_version": F.lit("features-0"), "reference_price": F.lit(0.0)})
        return rows.unionByName(old)

    def universe(self, **how) -> DataFrame:
        return ev.universe(self.events, self.live, self.coverage, self.notes, **how)

    @cached_property
    def live(self) -> DataFrame:
        gone = self.ledger.filter("day(earnings_date) = 5 AND feature_version = 'features-1'").select(*ev.LIVE_KEY, "source_evidence_sha256")
        return ev.live_features(self.ledger, gone)

    def _outcomes(self, digests: bool) -> DataFrame:
        bars = self.unfolded(*oc.PHASES)
        o = oc.session_outcomes(self.events, self.coverage, bars, self.days, now=NOW)
        return stored(oc.with_outcome_digest(o, self.coverage, bars) if digests else o, "outcomes")

    @cached_property
    def outcomes(self) -> DataFrame:
        return self._outcomes(True)

    @cached_property
    def plain_outcomes(self) -> DataFrame:
        """outcomes without digests, whose texts of all bars take most of their time, for queries that read none."""
        return self.outcomes.drop("source_evidence_sha256") if "outcomes" in self.__dict__ else self._outcomes(False)


_KEPT: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, d: str) -> Inputs:
    key = (spark.sparkContext.applicationId, d)
    if key not in _KEPT:
        _KEPT[key] = Inputs(spark, d)
    return _KEPT[key]


def flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded, arrays as text."""
    return rounded(df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]), digits)


# --- evidence and features ---


def evidence_header(spark: SparkSession, d: str) -> DataFrame:
    x = inputs(spark, d)
    h = ev.evidence_header(x.events, x.coverage)
    keep = [f"{p}_{c}" for p in ("regular", "post") for c in ("expected_start", "expected_end", "received_at", "market_date", "collection_mode", "response_sha256")]
    return flat(h.select(*KEY, *keep, "data_quality_flags"))


def packed(df: DataFrame, by: list[str], *parts: str, numbered: bool = False) -> DataFrame:
    """by, n and rows: all rows of a group by time, and phase if numbered, one line of text each (numbers in millionths), as a group of an event's bars has hundreds of them.

    No two rows of a group share time and phase, and times are whole minutes. numbered: with each line's place before it."""
    kinds = dict(df.dtypes)
    text = {"double": ev.micro, "timestamp_ntz": lambda c: ev.stamp(c).cast("string"), "array<string>": lambda c: F.array_join(c, "+")}
    part = lambda c: F.coalesce(text.get(kinds[c], lambda x: x.cast("string"))(F.col(c)), F.lit("-"))
    # lines ready-made, as collect_list works what it is given out without generated code; they begin with what they are sorted by
    line = F.concat_ws("|", *([part("ts")] if numbered else []), *map(part, parts))
    each = F.sort_array(F.collect_list("line"))
    if numbered:  # 14: after the time, of twelve digits
        each = F.transform(each, lambda x, i: F.concat((i + 1).cast("string"), F.lit("|"), F.substring(x, 14, 1 << 20)))
    return df.select(*by, line.alias("line")).groupBy(*by).agg(F.count("*").alias("n"), F.array_join(each, ";").alias("rows"))


def phase_bars(spark: SparkSession, d: str) -> DataFrame:
    """Every bar of the retrieval that coverage names, of four retrievals of some minutes, the first of each time; a row an event and phase."""
    return packed(inputs(spark, d).first()(None), [*KEY, "phase"], "ts", "open", "high", "low", "close", "volume", "stale")


def feature_gates(spark: SparkSession, d: str) -> DataFrame:
    f = inputs(spark, d).features
    return flat(f.select(*KEY, "reaction_class", "reason", "observed_minutes", "source_bar_count", "data_quality_flags"))


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    return flat(inputs(spark, d).rows)


def _broken(rows: DataFrame) -> DataFrame:
    """Stored rows, some of them spoilt by the day of the month."""
    day = lambda n, v, c: F.when(F.dayofmonth("earnings_date") == n, v).otherwise(F.col(c))
    return rows.withColumns({
        "feature_window_end": day(1, F.col("feature_window_start"), "feature_window_end"), "label_cutoff_ts": day(2, F.col("feature_window_start"), "label_cutoff_ts"), "analysis_status_reason": day(4, F.lit(" "), "analysis_status_reason"),
        "earnings_regular_collection_mode": day(5, F.lit(None), "earnings_regular_collection_mode"), "reaction_timestamp": day(6, F.col("feature_window_end"), "reaction_timestamp"), "source_evidence_sha256": day(7, F.lit("x"), "source_evidence_sha256"),
        "return_5m": day(8, F.lit(None), "return_5m"), "reaction_direction": day(9, F.lit("flat"), "reaction_direction"), "analysis_status": day(10, F.lit("done"), "analysis_status"),
        "feature_cutoff_ts": day(11, F.col("feature_window_start"), "feature_cutoff_ts"), "earnings_postmarket_response_sha256": day(12, F.lit(None), "earnings_postmarket_response_sha256"),
    })


def feature_row_violations(spark: SparkSession, d: str) -> DataFrame:
    return ev.feature_violations(_broken(inputs(spark, d).rows))


def mode_violations(spark: SparkSession, d: str) -> DataFrame:
    """Coverage rows, some of them with a mode of no such kind."""
    c = inputs(spark, d).coverage.withColumn("collection_mode", F.expr("CASE day(earnings_date) WHEN 8 THEN NULL WHEN 9 THEN 'guessed' ELSE collection_mode END"))
    return ev.mode_violations(c, [*KEY, "phase"])


def feature_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """A run over all events against a ledger that has two thirds of them."""
    rows = inputs(spark, d).rows
    return ev.run_summary(rows, rows.filter("day(earnings_date) % 3 <> 0"))


# --- universe and reports ---


def universe(spark: SparkSession, d: str) -> DataFrame:
    return flat(inputs(spark, d).universe())


def universe_of_period(spark: SparkSession, d: str) -> DataFrame:
    """A period and a list of symbols."""
    u = inputs(spark, d).universe(start=WINDOW[0], end=WINDOW[1], symbols=[f"C{k}" for k in range(1, 60)])
    return u.select(*KEY, "analysis_status", "note_count", "study_ready", F.array_join("missing_phases", ",").alias("missing_phases"))


def all_quality_issues(spark: SparkSession, d: str) -> DataFrame:
    x = inputs(spark, d)
    return flat(ev.quality_issues(x.universe(), x.days, NOW))


def newest_quality_issues(spark: SparkSession, d: str) -> DataFrame:
    x = inputs(spark, d)
    return flat(reports.first_issues(ev.quality_issues(x.universe(), x.days, NOW)))


def issues_by_kind(spark: SparkSession, d: str) -> DataFrame:
    x = inputs(spark, d)
    return reports.issues_by_kind(ev.quality_issues(x.universe(), x.days, NOW))


def cohort_disclosure(spark: SparkSession, d: str) -> DataFrame:
    u = inputs(spark, d).universe()
    keeps = F.coalesce((F.col("reaction_direction") == "up") & (F.abs("initial_return") >= 1), F.lit(False))
    return reports.disclosure(u, keeps, 50, 10)


def trailing_universe(spark: SparkSession, d: str) -> DataFrame:
    u = reports.trailing(inputs(spark, d).universe(), NOW[:10])
    return u.select(*KEY, "analysis_status", "reaction_class")


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.value_counts(inputs(spark, d).universe(), ["reaction_direction", "earnings_postmarket_collection_mode", "analysis_status"]))


def scatter_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.scatter_series(inputs(spark, d).universe()))


def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    return reports.monthly_series(inputs(spark, d).universe())


def event_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every bar of all paths in order, with the horizons that stand on it; a row an event."""
    x = inputs(spark, d)
    return packed(reports.path_bars(x.first(), x.rows), list(KEY), "phase", "ts", "close", "change", "checkpoints", numbered=True)


def following_path(spark: SparkSession, d: str) -> DataFrame:
    """Every bar of the sessions after, with the marks of open and close and the reference price; a row an event and phase."""
    x = inputs(spark, d)
    return packed(reports.following_path(x.first("following_premarket", "following_regular"), x.rows), [*KEY, "phase"], "ts", "close", "mark", "reference_price")


def evidence_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every event and phase with what its coverage row says, or that there is none."""
    x = inputs(spark, d)
    return flat(reports.coverage_audit(x.events, x.coverage))


def operations_page(spark: SparkSession, d: str) -> DataFrame:
    """Newest and counted rows of the stored tables: one row each, side by side."""
    x = inputs(spark, d)
    e = x.events.agg(F.max("earnings_date").alias("last_event"), F.count("*").alias("events_total"), F.count_if(F.col("hour") == "amc").alias("events_amc"))
    mode = lambda m: F.count_if(F.col("collection_mode") == m)
    c = x.coverage.agg(F.max("received_at").alias("last_coverage"), F.count("*").alias("coverage_rows"), mode("scheduled_capture").alias("scheduled_rows"), mode("historical_backfill").alias("backfill_rows"))
    b = x.bars.agg(F.max("received_at").alias("last_bar"), F.count("*").alias("bar_rows"))
    q = fx.ticks(spark, d).agg(F.max("received_at").alias("last_quote"))
    f = x.ledger.agg(F.max("computed_at").alias("last_feature"), F.count("*").alias("feature_rows"))
    return e.crossJoin(c).crossJoin(b).crossJoin(q).crossJoin(f)  # one row each


def chart_rows(spark: SparkSession, d: str) -> DataFrame:
    """The newest events of the universe with their main numbers, as many as a chart draws."""
    u = inputs(spark, d).universe()
    return rounded(reports.newest(u.select(*KEY, "reaction_class", "initial_return", "return_105m", "retention"), reports.MOST_CHART_ROWS))


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """The newest events of the universe as an export writes them, as many as one file takes."""
    u = inputs(spark, d).universe()
    return exports.flat(rounded(reports.newest(u.select(*KEY, "analysis_status", "eps_surprise_pct", "covered_phases"), reports.MOST_EXPORT_ROWS)))


def row_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of event rows by their canonical text; a row with a number that is not finite would be refused."""
    e = inputs(spark, d).events.select(*KEY, "hour", "k", "eps_actual", F.when(F.col("k") % 5 != 0, F.col("superseded")).alias("superseded"))
    digest = row_digest("event-1", "symbol", "earnings_date", "hour", "k", "superseded")
    return e.select(*KEY, only_finite(e, digest).alias("sha256"))


def bar_mode_violations(spark: SparkSession, d: str) -> DataFrame:
    """Bars of one minute of each event under the four modes that bars may have, some under none or another."""
    modes = "CASE day(earnings_date) WHEN 8 THEN NULL WHEN 9 THEN 'guessed' ELSE element_at(array('legacy_unspecified', 'manual_collection', 'scheduled_capture', 'historical_backfill'), 1 + day(earnings_date) % 4) END"
    b = fx.bars(fx.events(spark, d)).withColumn("collection_mode", F.expr(modes))
    return ev.mode_violations(b, [*KEY, "phase", "minute", "id"], modes=ev.BAR_MODES)


def path_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.path_levels(inputs(spark, d).rows))


def event_detail(spark: SparkSession, d: str) -> DataFrame:
    """The five parts of every event of the universe, counted and joined."""
    x = inputs(spark, d)
    u = x.universe()
    p = reports.event_detail(u.select(*KEY), u, x.coverage, x.first(), x.notes, x.rows)
    count = lambda n, c: p[n].groupBy(*KEY).agg(F.count("*").alias(n), F.min(c).alias(f"first_{n}"))
    out = p["summary"].select(*KEY, "analysis_status")
    for part in (count("coverage", "expected_start"), count("bars", "ts"), count("notes", "created_at"), p["parameters"].select(*KEY, F.length("parameters").alias("parameters"))):
        out = out.join(part, list(KEY), "left")
    return out


def export_universe(spark: SparkSession, d: str) -> DataFrame:
    u = inputs(spark, d).universe()
    return exports.flat(rounded(u.select(*KEY, "eps_surprise_pct", "reaction_timestamp", "data_quality_flags", "missing_fields", "covered_phases", "missing_phases", "note_count")))


def export_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = inputs(spark, d).coverage
    ratio = F.least(F.lit(1.0), F.col("observed_minutes") / F.col("expected_minutes"))
    return exports.flat(rounded(c.select(*KEY, "phase", "expected_start", "data_quality_flags", ratio.alias("coverage_ratio"), F.greatest(F.col("expected_minutes") - F.col("observed_minutes"), F.lit(0)).alias("missing_minutes"))))


def phase_starts_eastern(spark: SparkSession, d: str) -> DataFrame:
    """Wall clock of the UTC bounds of every event's phases."""
    b = cal.phase_bounds(fx.events(spark, d).select(*KEY), core._calendar(spark, d))
    return b.select(*KEY, "phase", eastern(F.col("expected_start")).cast("timestamp_ntz").alias("start_eastern"), F.to_date(eastern(F.col("expected_end"))).alias("end_date"))


def normalized_symbols(spark: SparkSession, d: str) -> DataFrame:
    c = fx.read(spark, d, "customer").select("c_custkey", "c_name")
    raw = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat(' c', c_custkey, ' ') WHEN 1 THEN concat('c.', c_custkey) WHEN 2 THEN concat('1c', c_custkey) ELSE c_name END")
    return c.select("c_custkey", norm_symbol(raw).alias("symbol"))


def record_ages(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from each symbol's newest quote to now."""
    return fx.ticks(spark, d).groupBy("symbol").agg(reports.age_seconds(F.max("received_at"), "2030-01-01 00:00:00").alias("age_seconds"))


def asof_daily(spark: SparkSession, d: str) -> DataFrame:
    """The latest daily bar on or before each event, 30 days old at most."""
    e, b = fx.events(spark, d).select(*KEY), fx.daily_bars(spark, d).select("symbol", "session_date", "volume")
    return asof.asof_join(e, b, ["symbol"], "earnings_date", "session_date", tolerance=F.datediff("earnings_date", "session_date") <= 30)


def asof_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Each failed tick with the symbol's last priced one at or before it; the time line of a symbol with many ticks is cut into pieces."""
    t = fx.ticks(spark, d).select("symbol", "event_timestamp", "event_id", "event_type", "last")
    left = t.filter("event_type = 'error'").select("symbol", "event_timestamp", "event_id")
    right = t.filter("event_type <> 'error' AND last IS NOT NULL").select("symbol", F.col("event_timestamp").alias("quoted_at"), F.col("event_id").alias("quote_id"), "last")
    return rounded(asof.asof_join(left, right, ["symbol"], "event_timestamp", "quoted_at", tie=["quote_id"], piece_rows=TICK_ROWS))


#: Ticks of a piece of a symbol's time line in asof_ticks: few, so that the larger symbols of a small table are cut too.
TICK_ROWS = 50


def class_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of initial return and volume of each class, events without one among them."""
    u = stored(inputs(spark, d).universe().select("reaction_class", "initial_return", F.col("volume_105m").cast("double").alias("volume_105m")), "measures")
    each = [ranks.quantiles(u, ["reaction_class"], c, (0.25, 0.5, 0.75)).select(F.lit(c).alias("measure"), "*") for c in ("initial_return", "volume_105m")]
    x = each[0].unionByName(each[1])
    return rounded(x.select("measure", "reaction_class", "n", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)]))


# --- outcomes ---


def session_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return flat(inputs(spark, d).outcomes)


def stored_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a run adds to a ledger that already has the outcomes of odd days, in reading order."""
    o = oc.outcomes_to_store(inputs(spark, d).outcomes).withColumn("computed_at", F.lit(NOW).cast("timestamp_ntz"))
    key = [*KEY, "outcome_version", "source_evidence_sha256"]
    new = ledger.new_rows(o.filter("day(earnings_date) % 2 = 1").select(*key), o, key)
    return oc.read_outcomes(new).select(*key, "analysis_status")


def outcome_run_summary(spark: SparkSession, d: str) -> DataFrame:
    o = inputs(spark, d).outcomes
    key = [*KEY, "outcome_version", "source_evidence_sha256"]
    return ev.run_summary(o, oc.outcomes_to_store(o).filter("day(earnings_date) % 2 = 1"), key)


_OUTCOME = ["reference_close", *[f"premarket_{n}" for n in ("first", "high", "low", "last")], *[f"regular_{n}" for n in ("open", "high", "low", "close")]]
_OUTCOME += [*[f"{n}_return" for n in _OUTCOME[1:]], *[f"regular_return_{n}m" for n in oc.OPEN_MINUTES]]


def _spoilt_outcomes(rows: DataFrame) -> DataFrame:
    """Stored outcomes, some of them spoilt by the day of the month."""
    day = lambda n, v, c: F.when(F.dayofmonth("earnings_date") == n, v).otherwise(F.col(c)).alias(c)
    return rows.withColumns({
        "analysis_status_reason": day(1, F.lit("x"), "analysis_status_reason"), "missing_fields": day(2, F.array().cast("array<string>"), "missing_fields"), "regular_collection_mode": day(3, F.lit(None), "regular_collection_mode"),
        "following_regular_observed_minutes": day(4, F.lit(1000), "following_regular_observed_minutes"), "source_evidence_sha256": day(5, F.lit("x"), "source_evidence_sha256"), "analysis_status": day(6, F.lit("done"), "analysis_status"),
        "premarket_response_sha256": day(7, F.lit("bad"), "premarket_response_sha256"), "following_regular_collection_mode": day(8, F.lit("guessed"), "following_regular_collection_mode"), "reference_close": day(9, F.lit(None), "reference_close"),
    })


def outcome_violations(spark: SparkSession, d: str) -> DataFrame:
    return oc.outcome_violations(_spoilt_outcomes(oc.outcomes_to_store(inputs(spark, d).outcomes)))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Status, prices and returns of every event's next session by the calendar."""
    o = inputs(spark, d).plain_outcomes
    return flat(o.select(*KEY, "analysis_status", "missing_fields", *_OUTCOME, "following_regular_observed_minutes", "following_regular_coverage_ratio"))


def outcome_choice(spark: SparkSession, d: str) -> DataFrame:
    """Two outcomes an event: the one of later evidence is complete, or lacks its prices."""
    o = inputs(spark, d).plain_outcomes.select(*KEY, F.col("analysis_status").alias("status"), "regular_close_return", F.lit("b").alias("evidence_sha256"))
    later = F.expr("IF(day(earnings_date) < 15, 'complete', 'insufficient_data')")
    two = o.unionByName(o.withColumns({"status": later, "regular_close_return": F.lit(0.0), "evidence_sha256": F.lit("a")}))
    return rounded(selection.outcome_choice(two))


def outcome_parameters(spark: SparkSession, d: str) -> DataFrame:
    """What a run of a year stores: each outcome's identity and the definition that it was made under."""
    o = oc.outcomes_to_store(inputs(spark, d).outcomes, "1996-01-01", "1996-12-31")
    return o.select(*KEY, "outcome_version", "source_evidence_sha256", "parameters")


# --- studies ---


#: Limits and pins of the plans by their number n: in Spark's and in DuckDB's words.
_LIMITS = {
    "directions": ("CASE n % 3 WHEN 0 THEN array('up') WHEN 1 THEN array('down') END", "CASE n % 3 WHEN 0 THEN ['up'] WHEN 1 THEN ['down'] END"),
    "statuses": ("IF(n = 1, array('complete'), NULL)", "CASE WHEN n = 1 THEN ['complete'] END"),
    "classes": ("IF(n = 2, array('whipsaw', 'spike_and_fade'), IF(n = 11, array(), NULL))", "CASE WHEN n = 2 THEN ['whipsaw', 'spike_and_fade'] END"),
    "modes": ("IF(n = 3, array('scheduled_capture'), NULL)", "CASE WHEN n = 3 THEN ['scheduled_capture'] END"),
    "symbols": ("IF(n = 4, transform(sequence(1, 60), k -> concat('C', k)), NULL)", "CASE WHEN n = 4 THEN list_transform(range(1, 61), lambda k: 'C' || k) END"),
    **{f: (f"CASE WHEN {when} THEN {v}e0 END",) * 2 for f, when, v in (
        ("least_abs_return", "n % 2 = 0", "1"), ("most_delay", "n % 4 = 0", "60"), ("most_abs_return", "n = 5", "3"), ("least_retention", "n = 7", "5"), ("most_retention", "n = 9", "5"), ("least_delay", "n = 11", "10"),
        ("least_volume", "n = 13", "1200"), ("least_coverage", "n = 15", "1"), ("least_surprise", "n = 17", "0"), ("most_surprise", "n = 19", "5"))},
    "feature_version": ("IF(n = 21, 'features-0', 'features-1')", "CASE WHEN n = 21 THEN 'features-0' ELSE 'features-1' END"),
    "outcome_version": ("IF(n = 22, 'outcome-0', NULL)", "CASE WHEN n = 22 THEN 'outcome-0' ELSE 'outcome-1' END"),
}


def _plans(spark: SparkSession, d: str) -> DataFrame:
    n = fx.read(spark, d, "nation").select(F.col("n_nationkey").alias("n"))
    day = lambda s: F.lit(s).cast("date")
    return n.select(
        F.concat(F.lit("S"), F.col("n").cast("string")).alias("study_key"), F.lit(1).alias("version"), F.expr("date_add(DATE'1992-01-01', 30 * (n % 3))").alias("development_from"), day("1996-12-31").alias("development_to"),
        F.expr("IF(n = 24, DATE'1996-01-01', DATE'1997-01-01')").alias("oos_from"), F.expr("IF(n % 7 = 3, DATE'1998-03-31', DATE'1997-12-15')").alias("oos_to"), F.lit(5).alias("least_development"), F.lit(3).alias("least_oos"),
        F.expr("IF(n % 2 = 0, 'higher', 'lower')").alias("expected_direction"), *[F.expr(ours).alias(name) for name, (ours, _) in _LIMITS.items()],
    )


def _members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = inputs(spark, d)
    plans = _plans(spark, d)
    return plans, study.members(plans, ev.live_scope(x.events), x.live, x.outcomes.filter("day(earnings_date) <> 20"))


def all_study_members(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)[1]
    return flat(m.withColumn("member_sha256", study.member_digest()).select(*study.STUDY, "stage", *KEY, "delay_minutes", "metric", "reasons", "included", "eligible", "feature_status", "outcome_status", "flags", "member_sha256"))


def study_results(spark: SparkSession, d: str) -> DataFrame:
    """Both stages of every study, the sealed one under the rule that the development stage froze."""
    return rounded(study.results(_members(spark, d)[1]))


def _first_study(spark: SparkSession, d: str) -> DataFrame:
    """Members of one study's development stage."""
    x = inputs(spark, d)
    o = x.plain_outcomes.filter("day(earnings_date) <> 20").withColumn("source_evidence_sha256", F.lit(None).cast("string"))  # members show it, what is made of these does not
    m = study.members(_plans(spark, d).filter("study_key = 'S0'"), ev.live_scope(x.events), x.live, o)
    return m.filter("stage = 'development'")


def study_members(spark: SparkSession, d: str) -> DataFrame:
    return flat(_first_study(spark, d).select(*KEY, "delay_minutes", "metric", "reasons", "included", "eligible"))


def study_result(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.results(_first_study(spark, d)).drop(*study.STUDY, "stage"))


def exclusion_counter(spark: SparkSession, d: str) -> DataFrame:
    return _first_study(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def cohort_digests(spark: SparkSession, d: str) -> DataFrame:
    return study.cohort_digests(_members(spark, d)[1])


def study_detail(spark: SparkSession, d: str) -> DataFrame:
    plans, m = _members(spark, d)
    return study.study_detail(plans, study.results(m), m)


def study_violations(spark: SparkSession, d: str) -> DataFrame:
    """Members and results, some of them spoilt."""
    plans, m = _members(spark, d)
    bad = m.withColumn("included", F.when(F.dayofmonth("earnings_date") == 9, True).otherwise(F.col("included"))).withColumn("earnings_date", F.when(F.dayofmonth("earnings_date") == 11, F.date_add("earnings_date", 4000)).otherwise(F.col("earnings_date")))
    bad = bad.withColumn("outcome_version", F.when(F.dayofmonth("earnings_date") == 13, "outcome-x").otherwise(F.col("outcome_version")))
    told = {n: F.expr(f"IF(study_key LIKE '%{k}', array(), array('known'))") for k, n in ((6, "assumptions"), (7, "limitations"), (8, "failure_modes"))}
    r = study.results(m).withColumns(told).withColumns({"excluded_count": F.col("excluded_count") + F.expr("IF(study_key LIKE '%3', 1, 0)"), "decision": F.expr("IF(study_key LIKE '%4', 'paper_trade_candidate', decision)"), "threshold": F.expr("IF(study_key LIKE '%5', -1, threshold)")})
    return study.study_violations(r, bad, plans)


# --- reconciliation, liquidity, lists ---


def reconcile_window(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    every = evx.listings(e)
    fetched = every.filter(F.col("date").between(*[F.lit(x).cast("date") for x in WINDOW]))
    return ledger.reconcile_window(e, fetched, every, *WINDOW)


def unlisted_events(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    fetched = evx.listings(e).filter(F.col("date").between(*[F.lit(x).cast("date") for x in WINDOW]))
    return ledger.unlisted_events(e, fetched, *WINDOW).select(*KEY)


def live_after_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """After-close events that no action in force supersedes: first what is recorded, then the plan."""
    e = fx.events(spark, d)
    was = e.filter("superseded").select(*KEY, F.lit("supersede").alias("action"), F.lit(1).alias("at"))
    plan = reconcile_window(spark, d).select(*KEY, "action", F.lit(2).alias("at"))
    now = ledger.latest_actions(was.unionByName(plan), list(KEY))
    return e.filter("hour = 'amc'").select(*KEY).join(now.filter("action = 'supersede'"), list(KEY), "left_anti")


def liquidity_decisions(spark: SparkSession, d: str) -> DataFrame:
    x = inputs(spark, d)
    volume = ledger.liquidity(fx.daily_bars(spark, d)).withColumn("dollar_volume", F.col("dollar_volume").cast("double"))
    return ledger.liquidity_decisions(x.events, x.rows, volume, core.FLOOR)


def first_listed(spark: SparkSession, d: str) -> DataFrame:
    """Calendar entries that arrived several times, the first of each after-close symbol and date."""
    e = fx.events(spark, d).select("symbol", F.col("earnings_date").alias("date"), "hour", "k")
    twice = e.withColumn("n", F.explode(F.array(F.lit(2), F.lit(1), F.lit(3)))).withColumn("eps_estimate", F.col("k") * 10 + F.col("n"))
    return reports.first_listed(twice, "n").select("symbol", "date", "eps_estimate")


def stale_watchlists(spark: SparkSession, d: str) -> DataFrame:
    """A list per symbol, written on the day of its last event before now, for some without a date."""
    lists = fx.events(spark, d).filter(F.col("earnings_date") <= NOW[:10]).groupBy("symbol").agg(F.max("earnings_date").alias("as_of"), F.max("k").alias("k"))
    return reports.stale_watchlists(lists.select("symbol", F.when(F.col("k") % 7 != 0, F.col("as_of")).alias("as_of")), core._calendar(spark, d), NOW[:10])


def monitor_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Live after-close events of each day, in order."""
    e = selection.live_after_close(fx.events(spark, d)).select(*KEY)
    from pyspark.sql import Window

    return e.withColumn("place", F.row_number().over(Window.partitionBy("earnings_date").orderBy("symbol")))


QUERIES = {
    f.__name__: f
    for f in (
        evidence_header, phase_bars, feature_gates, feature_rows, feature_row_violations, mode_violations, feature_run_summary, universe, universe_of_period, all_quality_issues, newest_quality_issues, issues_by_kind,
        cohort_disclosure, trailing_universe, value_counts, scatter_points, monthly_series, event_paths, following_path, path_levels, evidence_audit, operations_page, chart_rows, export_rows, row_digests, bar_mode_violations, event_detail, export_universe, export_coverage, phase_starts_eastern,
        normalized_symbols, record_ages, asof_daily, asof_ticks, class_quantiles, session_outcomes, stored_outcomes, outcome_run_summary, outcome_violations, outcomes, outcome_choice, study_members, study_result, exclusion_counter, outcome_parameters, all_study_members, study_results, cohort_digests, study_detail, study_violations,
        reconcile_window, unlisted_events, live_after_reconcile, liquidity_decisions, first_listed, stale_watchlists, monitor_candidates,
    )
}

# --- the same results in SQL ---

_BASE = f"WITH {fx.DUCK_EVENTS}, {fx.DUCK_BARS}, {fx.DUCK_FOLLOWING}, {core._CAL}, {evx.DUCK_COVERAGE}, {evx.DUCK_RETRIEVED}, {evx.DUCK_NOTES}"
_PB = f"""{_BASE},
pb AS (SELECT v.symbol, v.earnings_date, v.phase, v.expected_start, v.expected_end, ts, open, high, low, close, volume, id, stale FROM rb b JOIN cov v
  ON b.symbol = v.symbol AND b.session = v.session AND b.evidence_date = v.market_date AND b.received_at = v.received_at AND b.source = v.source
  WHERE endpoint = '{evx.ENDPOINT}' AND ts >= expected_start AND ts < expected_end),
fb AS (SELECT * FROM pb QUALIFY row_number() OVER (PARTITION BY symbol, earnings_date, phase, ts ORDER BY id) = 1)"""
_DISTINCT = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_LIST = lambda *pairs: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in pairs) + "], lambda x: x IS NOT NULL)"
_BOTH = "list_concat(coalesce(r.data_quality_flags, []), coalesce(p.data_quality_flags, []))"
_SIDE = lambda a, short: ", ".join(f"{a}.{c} AS {short}_{c}" for c in ("expected_start", "expected_end", "received_at", "market_date", "collection_mode", "response_sha256"))
_HD = f"""{_PB},
hd0 AS (SELECT ev.symbol, ev.earnings_date, {_SIDE('r', 'regular')}, {_SIDE('p', 'post')}, {_BOTH} AS fl FROM ev
  LEFT JOIN cov r ON r.symbol = ev.symbol AND r.earnings_date = ev.earnings_date AND r.phase = 'earnings_regular'
  LEFT JOIN cov p ON p.symbol = ev.symbol AND p.earnings_date = ev.earnings_date AND p.phase = 'earnings_postmarket' WHERE hour = 'amc'),
hd AS (SELECT * EXCLUDE (fl), {_DISTINCT('fl')} AS flags FROM hd0)"""


def _adapt(text: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        if old not in text:
            raise ValueError(old)
        text = text.replace(old, new)
    return text


_STUDY_BARS = """sb AS (SELECT symbol, earnings_date, phase, CAST(date_diff('minute', CASE WHEN phase = 'earnings_regular' THEN expected_end ELSE expected_start END, ts) AS INT) AS minute,
  open, high, low, close, volume, id, stale FROM pb WHERE phase IN ('earnings_regular', 'earnings_postmarket'))"""
_FATAL = "list_sort(list_filter(flags, lambda x: x IN ('duplicate_minute_bars', 'no_bars_in_requested_phase', 'no_bars_returned')))"
_STALE = lambda p: f"(coalesce(stale_{p}, FALSE) AND ({p}_received_at IS NULL OR {p}_received_at < {p}_expected_end))"
_SIGNAL = _adapt(core._SIGNAL, ("FROM bar)", "FROM sb)"))
_CARRIED = "list_filter([" + ", ".join(f"CASE WHEN {h - 1} - at_{h} BETWEEN 1 AND 10 THEN 'checkpoint_{h}m_carried_forward_' || ({h - 1} - at_{h}) || 'm' END" for h in HORIZONS) + ", CASE WHEN vwap IS NULL THEN 'volume_unavailable_for_vwap' END], lambda x: x IS NOT NULL)"
_FEAT = _adapt(
    core._FEATURES,
    ("count(*) FILTER (" + core._BAD + ") AS bad,", f"""max(phase) FILTER ({core._BAD}) AS bad, count(*) AS n_bars, count(DISTINCT phase || minute) AS n_times,
    bool_or(phase = 'earnings_regular' AND stale) AS stale_regular, bool_or(phase = 'earnings_postmarket' AND stale) AS stale_post,"""),
    ("e.post_covered, e.stale, e.early_close,", "e.* EXCLUDE (symbol, earnings_date),"), ("FROM ev e LEFT JOIN ag", "FROM hd e LEFT JOIN ag"),
    ("CASE WHEN NOT post_covered THEN 'phase_not_covered' WHEN stale THEN 'stale_retrieval' WHEN early_close THEN 'early_close' WHEN bad > 0 THEN 'invalid_bar'", f"""CASE WHEN regular_received_at IS NULL OR post_received_at IS NULL THEN 'phase_not_covered'
         WHEN regular_expected_start IS NULL OR regular_expected_end IS NULL OR post_expected_start IS NULL OR post_expected_end IS NULL THEN 'bounds_missing'
         WHEN regular_expected_start >= regular_expected_end OR post_expected_start >= post_expected_end OR regular_expected_end <> post_expected_start THEN 'bounds_invalid'
         WHEN {_STALE('regular')} OR {_STALE('post')} THEN 'stale_retrieval' WHEN len({_FATAL}) > 0 THEN 'fatal_flags: ' || array_to_string({_FATAL}, ',')
         WHEN strftime(post_expected_start, '%H:%M') <> '16:00' THEN 'early_close' WHEN bad = 'earnings_regular' THEN 'invalid_regular_bar' WHEN bad = 'earnings_postmarket' THEN 'invalid_postmarket_bar'"""),
    ("WHEN post_bars > seen THEN 'duplicate_timestamp'", "WHEN n_bars > n_times THEN 'duplicate_timestamp' WHEN post_expected_start + INTERVAL 105 MINUTE > post_expected_end THEN 'coverage_ends_early'"),
    ("\n  FROM f4)", f""", post_expected_start, post_expected_end, regular_response_sha256, post_response_sha256, regular_collection_mode, post_collection_mode, coalesce(n_bars, 0) AS source_bar_count,
    CASE WHEN hard IS NULL THEN {_DISTINCT(f"list_concat(flags, {_CARRIED})")} ELSE flags END AS data_quality_flags
  FROM f4)"""),
)
_MICRO = " || ':' || ".join(f"CAST(round({c} * 1000000) AS BIGINT)" for c in ("open", "high", "low", "close"))
_OR = lambda c: f"coalesce({c}, '-')"
_TIME = lambda c: _OR(f"strftime({c}, '%Y%m%d%H%M')")
_IDS = " || chr(10) || ".join([_OR("regular_response_sha256"), _OR("post_response_sha256"), *[_TIME(f"{p}_expected_{e}") for p in ("regular", "post") for e in ("start", "end")]])
_F = f"""{_HD}, {_STUDY_BARS}, {_SIGNAL}, {_FEAT},
dig0 AS (SELECT symbol, earnings_date, string_agg(t, chr(10) ORDER BY t) AS body FROM (SELECT symbol, earnings_date, phase || ':' || strftime(ts, '%Y%m%d%H%M') || ':' || {_MICRO} || ':' || coalesce(CAST(volume AS VARCHAR), '-') AS t
  FROM pb WHERE phase IN ('earnings_regular', 'earnings_postmarket')) GROUP BY ALL),
dig AS (SELECT hd.symbol, hd.earnings_date, sha256(hd.symbol || chr(10) || strftime(hd.earnings_date, '%Y-%m-%d') || chr(10) || {_IDS} || chr(10) || coalesce(body, '')) AS source_evidence_sha256
  FROM hd LEFT JOIN dig0 ON hd.symbol = dig0.symbol AND hd.earnings_date = dig0.earnings_date)"""
_FITS = "post_expected_start < post_expected_end AND post_expected_start + INTERVAL 105 MINUTE <= post_expected_end"
_WHEN = lambda v: f"CASE WHEN {_FITS} THEN {v} END"
_MISSING = _LIST(*[(f"{s} IS NULL", n) for n, s in ev.NUMBERS.items()])
_ROW = f"""{_F},
frow AS (SELECT f.symbol, f.earnings_date, 'features-1' AS feature_version, 'detector-1' AS detector_version, 'classifier-1' AS classifier_version,
  CASE WHEN reaction_class IN ('insufficient_data', 'no_trigger_in_window') THEN reaction_class ELSE 'complete' END AS analysis_status,
  coalesce(reason, CASE WHEN reaction_class = 'no_trigger_in_window' THEN 'no_trigger_in_window' END) AS analysis_status_reason, CASE WHEN reaction_class <> 'insufficient_data' THEN reaction_class END AS reaction_class,
  CASE WHEN reaction_class = 'no_trigger_in_window' THEN 'flat' WHEN reaction_class <> 'insufficient_data' THEN CASE WHEN initial_return > 0 THEN 'up' ELSE 'down' END END AS reaction_direction,
  {_WHEN('post_expected_start')} AS feature_window_start, {_WHEN('post_expected_end')} AS feature_window_end, {_WHEN('post_expected_start + INTERVAL 105 MINUTE')} AS feature_cutoff_ts,
  {_WHEN('post_expected_start + INTERVAL 105 MINUTE')} AS label_cutoff_ts, post_expected_start + delay_minutes * INTERVAL 1 MINUTE AS reaction_timestamp, delay_minutes AS detection_delay_minutes,
  {', '.join(f'{s} AS {n}' for n, s in ev.NUMBERS.items())}, source_bar_count, CAST(least(observed_minutes, 105) AS INT) AS study_observed_minutes, CAST(105 - least(observed_minutes, 105) AS INT) AS study_missing_minutes,
  least(observed_minutes, 105) / 105 AS study_coverage_ratio, regular_response_sha256 AS earnings_regular_response_sha256, regular_collection_mode AS earnings_regular_collection_mode,
  post_response_sha256 AS earnings_postmarket_response_sha256, post_collection_mode AS earnings_postmarket_collection_mode, source_evidence_sha256,
  '{{"calendar":"XNYS","checkpoint_carry_minutes":10,"delayed_minutes":15,"fade_retracement_pct":50.0,"horizons":[1,5,15,30,60,105],"least_bars":5,"threshold_pct":2.0,"window_minutes":105}}' AS parameters,
  data_quality_flags, CASE WHEN reaction_class = 'insufficient_data' THEN {_MISSING} ELSE [] END AS missing_fields
  FROM feat f JOIN dig ON f.symbol = dig.symbol AND f.earnings_date = dig.earnings_date)"""
_DOUBLES = [n for n in ev.NUMBERS if not n.startswith("volume")] + ["study_coverage_ratio"]
_R = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
_J = lambda cols: ", ".join(f"array_to_string({c}, ',') AS {c}" for c in cols)
_ALLP = "['earnings_regular', 'earnings_postmarket', 'following_premarket', 'following_regular']"
_U = f"""{_ROW},
live AS (SELECT *, CAST(earnings_date AS TIMESTAMP) + INTERVAL 1 DAY AS computed_at FROM frow WHERE day(earnings_date) NOT IN (3, 5)),
cph2 AS (SELECT symbol, earnings_date, list_sort(list(phase)) AS covered_phases FROM cov GROUP BY ALL), nc AS (SELECT symbol, earnings_date, CAST(count(*) AS INT) AS note_count FROM note GROUP BY ALL),
u0 AS (SELECT e.symbol, e.earnings_date, e.hour, e.eps_estimate, e.eps_actual, e.revenue_estimate, e.revenue_actual, e.quarter, e.year,
    l.* EXCLUDE (symbol, earnings_date, feature_window_start, feature_window_end, feature_cutoff_ts, label_cutoff_ts, parameters, source_bar_count, data_quality_flags, missing_fields),
    coalesce(l.data_quality_flags, []) AS data_quality_flags, coalesce(l.missing_fields, []) AS missing_fields, coalesce(covered_phases, []) AS covered_phases, coalesce(note_count, 0) AS note_count
  FROM ev e LEFT JOIN live l ON l.symbol = e.symbol AND l.earnings_date = e.earnings_date LEFT JOIN cph2 c ON c.symbol = e.symbol AND c.earnings_date = e.earnings_date
  LEFT JOIN nc ON nc.symbol = e.symbol AND nc.earnings_date = e.earnings_date WHERE hour = 'amc' AND NOT illiquid AND NOT superseded),
u AS (SELECT *, CASE WHEN eps_estimate <> 0 THEN (eps_actual - eps_estimate) / abs(eps_estimate) * 100 END AS eps_surprise_pct,
  CASE WHEN revenue_estimate <> 0 THEN (revenue_actual - revenue_estimate) / abs(revenue_estimate) * 100 END AS revenue_surprise_pct, CASE WHEN initial_return <> 0 THEN return_105m / initial_return END AS retention,
  list_filter({_ALLP}, lambda p: NOT list_contains(covered_phases, p)) AS missing_phases, list_contains(covered_phases, 'earnings_regular') AND list_contains(covered_phases, 'earnings_postmarket') AS study_ready FROM u0)"""
_LATE = "list_filter(['earnings_regular', 'earnings_postmarket'], lambda p: NOT list_contains(covered_phases, p) AND TIMESTAMP '" + NOW + "' >= CAST(earnings_date AS TIMESTAMP) + CASE WHEN p = 'earnings_postmarket' THEN 1210 WHEN short THEN 790 ELSE 970 END * INTERVAL 1 MINUTE)"
_MODES = [f"coalesce(earnings_{p}_collection_mode, '')" for p in ("regular", "postmarket")]
_ISSUES = f"""{_U}, i0 AS (SELECT u.*, coalesce(cal.early_close, FALSE) AS short FROM u LEFT JOIN cal ON cal.day = u.earnings_date), i1 AS (SELECT *, {_LATE} AS late FROM i0),
i2 AS (SELECT *, CASE WHEN len(late) > 0 THEN 'missing_capture_phase' WHEN NOT study_ready THEN NULL WHEN analysis_status IS NULL THEN 'not_analyzed' WHEN analysis_status = 'insufficient_data' THEN 'insufficient_data'
  WHEN {_MODES[0]} = 'historical_backfill' OR {_MODES[1]} = 'historical_backfill' THEN 'historical_backfill' WHEN len(data_quality_flags) > 0 THEN 'data_quality_flag' END AS kind FROM i1),
iss AS (SELECT symbol, earnings_date, kind, CASE kind WHEN 'missing_capture_phase' THEN array_to_string(late, ', ') WHEN 'not_analyzed' THEN 'features-1/detector-1/classifier-1' WHEN 'insufficient_data' THEN analysis_status_reason
    WHEN 'historical_backfill' THEN {_MODES[0]} || '/' || {_MODES[1]} ELSE array_to_string(data_quality_flags, ', ') END AS detail,
  array_to_string(CASE kind WHEN 'missing_capture_phase' THEN late WHEN 'not_analyzed' THEN [] ELSE missing_phases END, ',') AS phases_missing,
  CASE WHEN kind NOT IN ('missing_capture_phase', 'not_analyzed') THEN study_observed_minutes END AS observed_minutes, CAST(CASE WHEN kind NOT IN ('missing_capture_phase', 'not_analyzed') THEN 105 END AS INT) AS expected_minutes FROM i2 WHERE kind IS NOT NULL)"""
_P = {"regular": ("earnings_regular", 390), "premarket": ("following_premarket", 150), "following_regular": ("following_regular", 390)}
_OBAD = "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR low > least(open, close) OR high < greatest(open, close) OR high < low"
_OPRICES = ["premarket_first", "premarket_high", "premarket_low", "premarket_last", "regular_open", "regular_high", "regular_low", "regular_close"]
_THERE = lambda s: f"{s}_o IS NOT NULL"
_RATIO = lambda s: f"CASE WHEN {_THERE(s)} THEN least(1, {s}_o / {s}_x) ELSE 0 END"
_BROKEN = [(f"b_{s}", f"{p}_invalid_bar") for s, (p, _) in _P.items()] + [(f"t_{s} > d_{s}", f"{p}_duplicate_timestamp") for s, (p, _) in _P.items()]
_LACK = [(f"{n} IS NULL", n) for n in ["reference_close", "reference_close_ts", *_OPRICES, *[f"regular_return_{n}m" for n in (5, 30, 60)]]]
_COVERED = [(f"{_THERE(s)} AND {_RATIO(s)} < 0.95", f"{_P[s][0]}_coverage") for s in ("regular", "following_regular")]
_THREE = "('earnings_regular', 'following_premarket', 'following_regular')"
_HEADS = " || '|' || ".join([
    "phase", "strftime(market_date, '%Y-%m-%d')", "session", _TIME("expected_start"), _TIME("expected_end"), _OR("CAST(observed_minutes AS VARCHAR)"), _OR("CAST(expected_minutes AS VARCHAR)"), _OR("source"), _TIME("received_at"),
    _OR("response_sha256"), _OR("collection_mode"), "array_to_string(list_sort(list_distinct(coalesce(data_quality_flags, []))), ',')",
])
_O = f"""od1 AS (SELECT symbol, earnings_date, string_agg(t, chr(10) ORDER BY t) AS heads FROM (SELECT symbol, earnings_date, {_HEADS} AS t FROM cov WHERE phase IN {_THREE}) GROUP BY ALL),
od2 AS (SELECT symbol, earnings_date, string_agg(t, chr(10) ORDER BY t) AS lines FROM (SELECT symbol, earnings_date, phase || ':' || strftime(ts, '%Y%m%d%H%M') || ':' || {_MICRO} || ':' || coalesce(CAST(volume AS VARCHAR), '-') AS t
  FROM pb WHERE phase IN {_THREE}) GROUP BY ALL),
oa0 AS (SELECT symbol, earnings_date, max(close) FILTER (phase = 'earnings_regular' AND ts = expected_end - INTERVAL 1 MINUTE) AS reference_close, max(ts) FILTER (phase = 'earnings_regular' AND ts = expected_end - INTERVAL 1 MINUTE) AS reference_close_ts,
  arg_min(open, ts) FILTER (phase = 'following_premarket') AS premarket_first, max(high) FILTER (phase = 'following_premarket') AS premarket_high, min(low) FILTER (phase = 'following_premarket') AS premarket_low,
  arg_max(close, ts) FILTER (phase = 'following_premarket') AS premarket_last, min(ts) FILTER (phase = 'following_premarket') AS premarket_first_ts, max(ts) FILTER (phase = 'following_premarket') AS premarket_last_ts,
  max(open) FILTER (phase = 'following_regular' AND ts = expected_start) AS regular_open, max(high) FILTER (phase = 'following_regular') AS regular_high, min(low) FILTER (phase = 'following_regular') AS regular_low,
  max(close) FILTER (phase = 'following_regular' AND ts = expected_end - INTERVAL 1 MINUTE) AS regular_close, {', '.join(f"max(close) FILTER (phase = 'following_regular' AND ts = expected_start + INTERVAL {n - 1} MINUTE) AS c_{n}" for n in (5, 30, 60))},
  {', '.join(f"coalesce(bool_or(phase = '{p}' AND ({_OBAD})), FALSE) AS b_{s}, count(*) FILTER (phase = '{p}') AS t_{s}, count(DISTINCT ts) FILTER (phase = '{p}') AS d_{s}" for s, (p, _) in _P.items())} FROM pb GROUP BY ALL),
ocv AS (SELECT symbol, earnings_date, {', '.join(f"max(observed_minutes) FILTER (phase = '{p}') AS {s}_o, max(expected_minutes) FILTER (phase = '{p}') AS {s}_x, max(expected_end) FILTER (phase = '{p}') AS {s}_e, max(response_sha256) FILTER (phase = '{p}') AS {s}_response_sha256, max(collection_mode) FILTER (phase = '{p}') AS {s}_collection_mode, any_value(data_quality_flags) FILTER (phase = '{p}') AS {s}_f" for s, (p, _) in _P.items())} FROM cov GROUP BY ALL),
oj AS (SELECT e.symbol, e.earnings_date, ocv.* EXCLUDE (symbol, earnings_date), oa0.* EXCLUDE (symbol, earnings_date, b_regular, b_premarket, b_following_regular, t_regular, t_premarket, t_following_regular, d_regular, d_premarket, d_following_regular),
    {', '.join(f'coalesce({x}_{s}, {z}) AS {x}_{s}' for s in _P for x, z in (('b', 'FALSE'), ('t', '0'), ('d', '0')))}, CAST(c.next AS TIMESTAMP) + CASE WHEN n.early_close THEN 790 ELSE 970 END * INTERVAL 1 MINUTE AS available_after
  FROM ev e JOIN cal c ON c.day = e.earnings_date JOIN cal n ON n.day = c.next LEFT JOIN ocv ON ocv.symbol = e.symbol AND ocv.earnings_date = e.earnings_date
  LEFT JOIN oa0 ON oa0.symbol = e.symbol AND oa0.earnings_date = e.earnings_date WHERE hour = 'amc'),
ok AS (SELECT *, {', '.join(f'(c_{n} - reference_close) / reference_close * 100 AS regular_return_{n}m' for n in (5, 30, 60))} FROM oj),
ol AS (SELECT *, {_LIST(*_LACK, *_COVERED, *_BROKEN)} AS miss, {_LIST(*[(f'NOT ({_THERE(s)})', p) for s, (p, _) in _P.items()])} AS absent, {_LIST(*_BROKEN)} AS broken FROM ok),
om AS (SELECT *, CASE WHEN TIMESTAMP '{NOW}' < available_after AND (following_regular_o IS NULL OR TIMESTAMP '{NOW}' < following_regular_e OR following_regular_o < following_regular_x) THEN 'not_yet_available'
  WHEN len(miss) > 0 THEN 'insufficient_data' ELSE 'complete' END AS analysis_status FROM ol),
so AS (SELECT om.symbol, om.earnings_date, 'outcome-1' AS outcome_version, analysis_status, CASE analysis_status WHEN 'not_yet_available' THEN 'session_not_complete' WHEN 'insufficient_data' THEN 'evidence_missing' END AS analysis_status_reason,
  reference_close, reference_close_ts, premarket_first, premarket_first_ts, premarket_high, premarket_low, premarket_last, premarket_last_ts, regular_open, regular_high, regular_low, regular_close,
  {', '.join(f'(({n} - reference_close) / reference_close * 100) AS {n}_return' for n in _OPRICES)}, regular_return_5m, regular_return_30m, regular_return_60m, (regular_open - reference_close) / reference_close * 100 AS overnight_gap_return,
  {', '.join(f'CAST(coalesce({s}_o, 0) AS INT) AS {s}_observed_minutes, CAST(coalesce({s}_x, {m}) AS INT) AS {s}_expected_minutes, {_RATIO(s)} AS {s}_coverage_ratio, {s}_response_sha256, {s}_collection_mode' for s, (_, m) in _P.items())},
  list_sort(list_distinct(list_concat(absent, miss))) AS missing_fields, list_sort(list_distinct(list_concat(coalesce(regular_f, []), coalesce(premarket_f, []), coalesce(following_regular_f, []), broken))) AS data_quality_flags, available_after,
  sha256(om.symbol || chr(10) || strftime(om.earnings_date, '%Y-%m-%d') || chr(10) || coalesce(heads, '') || chr(10) || coalesce(lines, '')) AS source_evidence_sha256
  FROM om LEFT JOIN od1 ON om.symbol = od1.symbol AND om.earnings_date = od1.earnings_date LEFT JOIN od2 ON om.symbol = od2.symbol AND om.earnings_date = od2.earnings_date)"""
_SO = f"{_PB}, {_O}"
_ORETURNS = ["reference_close", *_OPRICES, *[f"{n}_return" for n in _OPRICES], *[f"regular_return_{n}m" for n in (5, 30, 60)], "overnight_gap_return", *[f"{s}_coverage_ratio" for s in _P]]
_M_LISTS = [(n, c, code) for n, c, code in (("statuses", "analysis_status", "analysis_status"), ("classes", "reaction_class", "reaction_class"), ("directions", "reaction_direction", "reaction_direction"), ("modes", "earnings_postmarket_collection_mode", "postmarket_collection_mode"))]
_M_BOUNDS = [
    ("least_abs_return", "abs(initial_return) >=", "min_abs_initial_return"), ("most_abs_return", "abs(initial_return) <=", "max_abs_initial_return"), ("least_retention", "retention >=", "min_retention"), ("most_retention", "retention <=", "max_retention"),
    ("least_delay", "detection_delay_minutes >=", "min_detection_delay"), ("most_delay", "detection_delay_minutes <=", "max_detection_delay"), ("least_volume", "volume_105m >=", "min_volume_105m"), ("least_coverage", "study_coverage_ratio >=", "min_coverage_ratio"),
    ("least_surprise", "eps_surprise_pct >=", "min_eps_surprise_pct"), ("most_surprise", "eps_surprise_pct <=", "max_eps_surprise_pct"),
]
_M_WHY = [(f"len({n}) > 0 AND NOT coalesce(list_contains({n}, {c}), FALSE)", f"{code}_excluded") for n, c, code in _M_LISTS] + [(f"{n} IS NOT NULL AND NOT coalesce({ask} {n}, FALSE)", f"{code}_excluded") for n, ask, code in _M_BOUNDS]
_DONE = "coalesce(analysis_status = 'complete', FALSE)"
_M_OUT = [(f"NOT ({_DONE} AND detection_delay_minutes IS NOT NULL)", "feature_not_complete"), ("o_status IS NULL", "outcome_missing"), ("o_status IS NOT NULL AND (o_status <> 'complete' OR o_metric IS NULL)", "outcome_not_complete")]
_PLAN = """plan AS (SELECT 'S' || n_nationkey AS study_key, 1 AS version, DATE '1992-01-01' + CAST(30 * (n_nationkey % 3) AS INT) AS development_from, DATE '1996-12-31' AS development_to,
  CASE WHEN n_nationkey = 24 THEN DATE '1996-01-01' ELSE DATE '1997-01-01' END AS oos_from, CASE WHEN n_nationkey % 7 = 3 THEN DATE '1998-03-31' ELSE DATE '1997-12-15' END AS oos_to, 5 AS least_development, 3 AS least_oos,
  CASE WHEN n_nationkey % 2 = 0 THEN 'higher' ELSE 'lower' END AS way, """ + ", ".join(f"{theirs} AS {name}" for name, (_, theirs) in _LIMITS.items()) + " FROM (SELECT *, n_nationkey AS n FROM nation))"
_T = lambda c: f"coalesce(CAST({c} AS VARCHAR), '-')"
_MEM = f"""{_U}, {_O}, {_PLAN}, st(stage) AS (VALUES ('development'), ('oos')),
pl AS (SELECT plan.*, stage, CASE stage WHEN 'oos' THEN oos_from ELSE development_from END AS s, CASE stage WHEN 'oos' THEN oos_to ELSE development_to END AS z, CASE stage WHEN 'oos' THEN least_oos ELSE least_development END AS least FROM plan, st),
sc AS (SELECT symbol, earnings_date, CASE WHEN eps_estimate <> 0 THEN (eps_actual - eps_estimate) / abs(eps_estimate) * 100 END AS eps_surprise_pct FROM ev WHERE hour = 'amc' AND NOT illiquid AND NOT superseded),
fv AS (SELECT * FROM frow WHERE day(earnings_date) NOT IN (3, 5) UNION ALL SELECT * REPLACE ('features-0' AS feature_version) FROM frow WHERE day(earnings_date) < 10 AND day(earnings_date) <> 3),
uo AS (SELECT pl.* EXCLUDE (feature_version), pl.feature_version AS pinned, sc.*, f.* EXCLUDE (symbol, earnings_date, feature_version, data_quality_flags), coalesce(f.data_quality_flags, []) AS data_quality_flags, CASE WHEN initial_return <> 0 THEN return_105m / initial_return END AS retention,
    so.analysis_status AS o_status, so.regular_close_return AS o_metric, so.source_evidence_sha256 AS o_sha, coalesce(so.data_quality_flags, []) AS o_flags
  FROM pl JOIN sc ON sc.earnings_date BETWEEN s AND z AND (symbols IS NULL OR list_contains(symbols, sc.symbol)) LEFT JOIN fv f ON f.symbol = sc.symbol AND f.earnings_date = sc.earnings_date AND f.feature_version = pl.feature_version
  LEFT JOIN so ON so.symbol = sc.symbol AND so.earnings_date = sc.earnings_date AND day(so.earnings_date) <> 20 AND so.outcome_version = pl.outcome_version),
me0 AS (SELECT *, list_sort({_LIST(*_M_WHY, *_M_OUT)}) AS reasons, len({_LIST(*_M_WHY)}) = 0 AND {_DONE} AS eligible, list_sort(list_distinct(list_concat(data_quality_flags, o_flags))) AS flags FROM uo),
me AS (SELECT study_key, version, stage, least, way, symbol, earnings_date, detection_delay_minutes AS delay_minutes, CASE WHEN o_status = 'complete' THEN o_metric END AS metric, reasons, len(reasons) = 0 AS included, eligible,
  analysis_status AS feature_status, o_status AS outcome_status, flags, sha256(symbol || '|' || strftime(earnings_date, '%Y-%m-%d') || '|' || pinned || '|detector-1|classifier-1|' || outcome_version || '|' || (len(reasons) = 0) || '|' || array_to_string(reasons, ',') || '|' || {_T('analysis_status')} || '|' || {_T('source_evidence_sha256')} || '|' || {_T('o_status')} || '|' || {_T('o_sha')} || '|' || array_to_string(flags, ',')) AS member_sha256 FROM me0)"""


def _results(stage: str, threshold: str) -> str:
    return f"""r_{stage} AS (SELECT study_key, version, max(threshold) AS threshold, count(*) AS universe_count, count(*) FILTER (included) AS n, count(*) FILTER (eligible) AS eligible, count(*) FILTER (included AND delay_minutes <= threshold) AS n_early,
  count(*) FILTER (included AND delay_minutes > threshold) AS n_late, count(*) FILTER (outcome_status = 'complete') AS complete_outcomes, count(*) FILTER (outcome_status = 'insufficient_data') AS insufficient_outcomes,
  avg(metric) FILTER (included AND delay_minutes <= threshold) AS early_mean, avg(metric) FILTER (included AND delay_minutes > threshold) AS late_mean, max(least) AS least, max(way) AS way
  FROM me JOIN ({threshold}) USING (study_key, version) WHERE stage = '{stage}' GROUP BY ALL),
q_{stage} AS (SELECT *, early_mean - late_mean AS difference, universe_count - n AS excluded_count, n >= least AND n_early > 0 AND n_late > 0 AS sample_gate, eligible = n AS coverage_gate FROM r_{stage})"""


_DEV = f"{_MEM}, {_results('development', "SELECT study_key, version, median(delay_minutes) FILTER (included) AS threshold FROM me WHERE stage = 'development' GROUP BY ALL")}"
_OOS = f"{_DEV}, {_results('oos', 'SELECT study_key, version, threshold FROM r_development')}"
_SEALED = "CASE WHEN sample_gate AND coverage_gate AND coalesce(CASE WHEN way = 'higher' THEN difference > 0 ELSE difference < 0 END, FALSE) THEN 'paper_trade_candidate' ELSE 'reject' END"
_RESULT = "study_key, version, universe_count, n, eligible, n_early, n_late, complete_outcomes, insufficient_outcomes, excluded_count, sample_gate, coverage_gate, " + _R(["threshold", "early_mean", "late_mean", "difference"])
_ROOT = """d1 AS (SELECT study_key, version, stage, earnings_date, count(*) AS c, sha256(string_agg(symbol || ':' || member_sha256, chr(10) ORDER BY symbol)) AS s FROM me GROUP BY ALL),
d2 AS (SELECT study_key, version, stage, strftime(earnings_date, '%Y-%m') AS month, sum(c) AS c, sha256(string_agg(strftime(earnings_date, '%Y-%m-%d') || ':' || s, chr(10) ORDER BY earnings_date)) AS s FROM d1 GROUP BY ALL),
d3 AS (SELECT study_key, version, stage, CAST(sum(c) AS BIGINT) AS members, sha256(string_agg(month || ':' || s, chr(10) ORDER BY month)) AS s FROM d2 GROUP BY ALL)"""
_IN_WINDOW = f"BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'"
_RECON = f"""WITH {fx.DUCK_EVENTS}, {evx.DUCK_LISTINGS}, fe AS (SELECT * FROM lis WHERE date {_IN_WINDOW}),
un AS (SELECT symbol, earnings_date FROM ev WHERE hour = 'amc' AND NOT superseded AND earnings_date {_IN_WINDOW} AND NOT EXISTS (SELECT 1 FROM fe WHERE fe.symbol = ev.symbol AND fe.date = ev.earnings_date)),
ug AS (SELECT symbol, min(earnings_date) - 75 AS a, max(earnings_date) + 75 AS z FROM un GROUP BY ALL), evi AS (SELECT * FROM fe UNION ALL SELECT lis.* FROM lis JOIN ug ON lis.symbol = ug.symbol AND date BETWEEN a AND z),
su AS (SELECT symbol, year, quarter, min(date) AS listed FROM evi GROUP BY ALL HAVING min(date) = max(date)),
rp0 AS (SELECT ev.symbol, earnings_date, listed, ev.year, ev.quarter, CASE WHEN listed <> earnings_date AND NOT superseded THEN 'supersede' WHEN listed = earnings_date AND superseded THEN 'reinstate' END AS action
  FROM ev JOIN su ON ev.symbol = su.symbol AND ev.year = su.year AND ev.quarter = su.quarter WHERE hour = 'amc'),
rp AS (SELECT symbol, earnings_date, action, CAST(listed AS DATE) AS listed, CASE WHEN action = 'supersede' THEN 'Q' || quarter || ' of ' || year || ' is listed on ' || strftime(listed, '%Y-%m-%d') END AS reason FROM rp0 WHERE action IS NOT NULL)"""
_CHANGED = """SELECT * REPLACE (CASE day(earnings_date) WHEN 1 THEN feature_window_start ELSE feature_window_end END AS feature_window_end, CASE day(earnings_date) WHEN 2 THEN feature_window_start ELSE label_cutoff_ts END AS label_cutoff_ts,
  CASE day(earnings_date) WHEN 4 THEN ' ' ELSE analysis_status_reason END AS analysis_status_reason, CASE WHEN day(earnings_date) <> 5 THEN earnings_regular_collection_mode END AS earnings_regular_collection_mode,
  CASE day(earnings_date) WHEN 6 THEN feature_window_end ELSE reaction_timestamp END AS reaction_timestamp, CASE day(earnings_date) WHEN 7 THEN 'x' ELSE source_evidence_sha256 END AS source_evidence_sha256,
  CASE WHEN day(earnings_date) <> 8 THEN return_5m END AS return_5m, CASE day(earnings_date) WHEN 9 THEN 'flat' ELSE reaction_direction END AS reaction_direction, CASE day(earnings_date) WHEN 10 THEN 'done' ELSE analysis_status END AS analysis_status,
  CASE day(earnings_date) WHEN 11 THEN feature_window_start ELSE feature_cutoff_ts END AS feature_cutoff_ts, CASE WHEN day(earnings_date) <> 12 THEN earnings_postmarket_response_sha256 END AS earnings_postmarket_response_sha256) FROM frow"""
_FILLED = " + ".join(f"({n} IS NOT NULL)::INT" for n in ev.NUMBERS)
_NOSIG = " AND ".join(f"{n} IS NULL" for n in ("reaction_timestamp", "detection_delay_minutes", "initial_return", "max_favorable_excursion", "max_adverse_excursion", "max_retracement"))
_WIN = "feature_window_start IS NOT NULL AND feature_window_end IS NOT NULL AND feature_cutoff_ts IS NOT NULL AND label_cutoff_ts IS NOT NULL"
_SHAS = "earnings_regular_response_sha256 IS NOT NULL AND earnings_postmarket_response_sha256 IS NOT NULL"
_RULES = [
    ("feature_window_end <= feature_window_start", "window_reversed"), ("feature_cutoff_ts <= feature_window_start", "cutoff_before_start"), ("label_cutoff_ts < feature_cutoff_ts", "label_before_cutoff"),
    ("label_cutoff_ts > feature_window_end", "label_after_window"), ("trim(analysis_status_reason) = ''", "blank_reason"),
    ("(earnings_regular_response_sha256 IS NULL) <> (earnings_regular_collection_mode IS NULL)", "regular_identity_unpaired"), ("(earnings_postmarket_response_sha256 IS NULL) <> (earnings_postmarket_collection_mode IS NULL)", "postmarket_identity_unpaired"),
    ("reaction_timestamp NOT BETWEEN feature_window_start AND feature_cutoff_ts", "signal_outside_window"), ("NOT regexp_full_match(source_evidence_sha256, '[0-9a-f]{64}')", "bad_evidence_digest"),
    (f"""analysis_status = 'complete' AND NOT coalesce(reaction_class IN ('immediate_continuation', 'spike_and_fade', 'delayed_breakout', 'whipsaw') AND reaction_direction IN ('up', 'down') AND reaction_timestamp IS NOT NULL
      AND detection_delay_minutes IS NOT NULL AND analysis_status_reason IS NULL AND {_WIN} AND {_SHAS} AND {_FILLED} = 20 AND len(missing_fields) = 0, FALSE)""", "complete_row_incomplete"),
    (f"""analysis_status = 'no_trigger_in_window' AND NOT coalesce(reaction_class = 'no_trigger_in_window' AND reaction_direction = 'flat' AND {_NOSIG} AND analysis_status_reason IS NOT NULL AND {_WIN} AND {_SHAS}
      AND {_FILLED} = 16 AND len(missing_fields) = 0, FALSE)""", "no_trigger_in_window_row_incomplete"),
    (f"analysis_status = 'insufficient_data' AND NOT coalesce(reaction_class IS NULL AND reaction_direction IS NULL AND {_NOSIG} AND analysis_status_reason IS NOT NULL AND len(missing_fields) > 0, FALSE)", "insufficient_data_row_incomplete"),
    ("analysis_status NOT IN ('complete', 'no_trigger_in_window', 'insufficient_data')", "unknown_status"),
]
_SPOILT = """SELECT * REPLACE (CASE day(earnings_date) WHEN 1 THEN 'x' ELSE analysis_status_reason END AS analysis_status_reason, CASE day(earnings_date) WHEN 2 THEN [] ELSE missing_fields END AS missing_fields,
  CASE WHEN day(earnings_date) <> 3 THEN regular_collection_mode END AS regular_collection_mode, CASE day(earnings_date) WHEN 4 THEN 1000 ELSE following_regular_observed_minutes END AS following_regular_observed_minutes,
  CASE day(earnings_date) WHEN 5 THEN 'x' ELSE source_evidence_sha256 END AS source_evidence_sha256, CASE day(earnings_date) WHEN 6 THEN 'done' ELSE analysis_status END AS analysis_status,
  CASE day(earnings_date) WHEN 7 THEN 'bad' ELSE premarket_response_sha256 END AS premarket_response_sha256, CASE day(earnings_date) WHEN 8 THEN 'guessed' ELSE following_regular_collection_mode END AS following_regular_collection_mode,
  CASE WHEN day(earnings_date) <> 9 THEN reference_close END AS reference_close) FROM s0"""
_O_FULL = " AND ".join(f"{n} IS NOT NULL" for n in ["reference_close", "reference_close_ts", *_OPRICES, *[f"regular_return_{n}m" for n in (5, 30, 60)]])
_O_RULES = [
    (f"analysis_status = 'complete' AND NOT (analysis_status_reason IS NULL AND len(missing_fields) = 0 AND {_O_FULL})", "complete_row_incomplete"),
    ("analysis_status = 'insufficient_data' AND NOT (analysis_status_reason IS NOT NULL AND len(missing_fields) > 0)", "insufficient_data_row_incomplete"), ("analysis_status NOT IN ('complete', 'insufficient_data')", "unknown_status"),
    ("NOT regexp_full_match(source_evidence_sha256, '[0-9a-f]{64}')", "bad_evidence_digest"),
    *[r for s in _P for r in (
        (f"({s}_response_sha256 IS NULL) <> ({s}_collection_mode IS NULL)", f"{s}_identity_unpaired"), (f"{s}_observed_minutes > {s}_expected_minutes", f"{s}_minutes_exceed"),
        (f"NOT regexp_full_match({s}_response_sha256, '[0-9a-f]{{64}}')", f"{s}_bad_response_digest"), (f"{s}_collection_mode NOT IN ('scheduled_capture', 'historical_backfill')", f"{s}_unknown_mode"),
    )],
]
_SUMMARY = lambda known: f"""count(*) AS scanned, count(*) FILTER (analysis_status = 'complete') AS complete, count(*) FILTER (analysis_status = 'no_trigger_in_window') AS no_trigger_in_window,
count(*) FILTER (analysis_status = 'insufficient_data') AS insufficient_data, count(*) FILTER (analysis_status = 'not_yet_available') AS not_yet_available, count(*) FILTER (analysis_status <> 'not_yet_available' AND NOT ({known})) AS inserted,
count(*) FILTER (analysis_status <> 'not_yet_available' AND {known}) AS conflicted"""  # noqa: E731
_ORDERED = ", ".join(f"max(minute) FILTER (phase = 'earnings_postmarket' AND minute < {h}) OVER (PARTITION BY symbol, earnings_date) AS l_{h}" for h in HORIZONS)
_POINTS = " UNION ALL ".join(f"SELECT symbol, earnings_date, coalesce(reaction_class, 'not_analyzed') AS reaction_class, '{n}' AS series, round(CAST({x} AS DOUBLE), 6) AS x, round({y}, 6) AS y FROM u WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for n, (x, y) in reports.SERIES.items())
_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce({c}, 'none') AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM u), 6) AS share FROM u GROUP BY ALL" for c in ("reaction_direction", "earnings_postmarket_collection_mode", "analysis_status"))
_KEEPS = "coalesce(reaction_direction = 'up' AND abs(initial_return) >= 1, FALSE)"
_ON = lambda a, b: f"{a}.symbol = {b}.symbol AND {a}.earnings_date = {b}.earnings_date"
_ISO = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"

_LINE = lambda *parts: " || '|' || ".join(parts)
_M = lambda c: f"coalesce(CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR), '-')"

ORACLE_SQL = {
    "evidence_header": f"{_HD} SELECT * EXCLUDE (flags), array_to_string(flags, ',') AS data_quality_flags FROM hd",
    "phase_bars": f"{_PB} SELECT symbol, earnings_date, phase, count(*) AS n, string_agg({_LINE(_TIME('ts'), *map(_M, ('open', 'high', 'low', 'close')), _OR('CAST(volume AS VARCHAR)'), _OR('CAST(stale AS VARCHAR)'))}, ';' ORDER BY ts) AS rows FROM fb GROUP BY ALL",
    "feature_gates": f"{_F} SELECT symbol, earnings_date, reaction_class, reason, observed_minutes, source_bar_count, {_J(['data_quality_flags'])} FROM feat",
    "feature_rows": f"{_ROW} SELECT * REPLACE ({_R(_DOUBLES)}, {_J(['data_quality_flags', 'missing_fields'])}) FROM frow",
    "feature_row_violations": f"{_ROW}, x AS ({_CHANGED}) SELECT symbol, earnings_date, unnest({_LIST(*[(c, n) for c, n in _RULES])}) AS rule FROM x",
    "mode_violations": f"{_BASE} SELECT symbol, earnings_date, phase, CASE day(earnings_date) WHEN 8 THEN 'no_collection_mode' ELSE 'unknown_collection_mode' END AS rule FROM cov WHERE day(earnings_date) IN (8, 9)",
    "feature_run_summary": f"{_ROW} SELECT {_SUMMARY('day(earnings_date) % 3 <> 0')} FROM frow",
    "universe": f"{_U} SELECT * REPLACE ({_R([*_DOUBLES, 'eps_estimate', 'eps_actual', 'revenue_estimate', 'revenue_actual', 'eps_surprise_pct', 'revenue_surprise_pct', 'retention'])}, {_J(['data_quality_flags', 'missing_fields', 'covered_phases', 'missing_phases'])}) FROM u",
    "universe_of_period": f"{_U} SELECT symbol, earnings_date, analysis_status, note_count, study_ready, {_J(['missing_phases'])} FROM u WHERE earnings_date {_IN_WINDOW} AND symbol IN (SELECT 'C' || x FROM range(1, 60) t(x))",
    "all_quality_issues": f"{_ISSUES} SELECT * FROM iss",
    "newest_quality_issues": f"{_ISSUES} SELECT * FROM iss ORDER BY earnings_date DESC, symbol LIMIT 500",
    "issues_by_kind": f"{_ISSUES} SELECT kind, count(*) AS n, min(earnings_date) AS first, max(earnings_date) AS last FROM iss GROUP BY ALL",
    "cohort_disclosure": f"""{_U}, ex AS (SELECT coalesce(analysis_status, 'not_analyzed') AS status, count(*) AS n FROM u WHERE NOT {_KEEPS} GROUP BY ALL), dc AS (SELECT count(*) AS universe_count, count(*) FILTER ({_KEEPS}) AS included_count FROM u)
SELECT universe_count, included_count, universe_count - included_count AS excluded_count, (SELECT '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' FROM ex) AS excluded_by_status,
greatest(least(included_count - 10, 50), 0) AS page_count, greatest(least(included_count - 10, 50), 0) < included_count AS truncated FROM dc""",
    "trailing_universe": f"{_U} SELECT symbol, earnings_date, analysis_status, reaction_class FROM u WHERE earnings_date BETWEEN DATE '{NOW[:10]}' - 180 AND DATE '{NOW[:10]}'",
    "value_counts": f"{_U} {_COUNTS}",
    "scatter_points": f"{_U} {_POINTS}",
    "monthly_series": f"{_U} SELECT strftime(earnings_date, '%Y-%m') AS month, count(*) FILTER (analysis_status = 'complete') AS complete, count(*) FILTER (analysis_status IS DISTINCT FROM 'complete') AS not_complete FROM u GROUP BY ALL",
    "event_paths": f"""{_ROW}, m AS (SELECT *, CAST(date_diff('minute', CASE WHEN phase = 'earnings_regular' THEN expected_end ELSE expected_start END, ts) AS INT) AS minute FROM fb), l AS (SELECT *, {_ORDERED} FROM m),
j AS (SELECT l.symbol, l.earnings_date, row_number() OVER (PARTITION BY l.symbol, l.earnings_date ORDER BY ts, phase) AS place, phase, ts, close, (close - reference_price) / nullif(reference_price, 0) * 100 AS change,
  array_to_string({_LIST(*[(f"phase = 'earnings_postmarket' AND minute = l_{h} AND minute >= {h - 11}", f"{h}m") for h in HORIZONS])}, '+') AS checkpoints FROM l LEFT JOIN frow f ON {_ON('l', 'f')})
SELECT symbol, earnings_date, count(*) AS n, string_agg({_LINE('CAST(place AS VARCHAR)', 'phase', _TIME('ts'), _M('close'), _M('change'), 'checkpoints')}, ';' ORDER BY place) AS rows FROM j GROUP BY ALL""",
    "following_path": f"""{_ROW}, w AS (SELECT *, min(ts) FILTER (phase = 'following_regular') OVER (PARTITION BY symbol, earnings_date) AS a, max(ts) FILTER (phase = 'following_regular') OVER (PARTITION BY symbol, earnings_date) AS z
  FROM fb WHERE phase LIKE 'following%')
SELECT w.symbol, w.earnings_date, phase, count(*) AS n, string_agg({_LINE(_TIME('ts'), _M('close'), _OR("CASE WHEN phase <> 'following_regular' THEN NULL WHEN ts = a THEN 'open' WHEN ts = z THEN 'close' END"), _M('reference_price'))}, ';' ORDER BY ts) AS rows
FROM w LEFT JOIN frow f ON {_ON('w', 'f')} GROUP BY ALL""",
    "evidence_audit": f"""{_BASE}, ap AS (SELECT symbol, earnings_date, unnest({_ALLP}) AS phase FROM ev WHERE hour = 'amc')
SELECT ap.symbol, ap.earnings_date, ap.phase, market_date, session, expected_start, expected_end, observed_minutes, expected_minutes, received_at, response_sha256, collection_mode, array_to_string(data_quality_flags, ',') AS data_quality_flags,
CASE WHEN cov.symbol IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS state FROM ap LEFT JOIN cov ON {_ON('ap', 'cov')} AND ap.phase = cov.phase""",
    "operations_page": f"""{_ROW}, {fx.DUCK_TICKS}, lg AS (SELECT earnings_date FROM frow WHERE day(earnings_date) <> 3 UNION ALL SELECT earnings_date FROM frow WHERE day(earnings_date) <> 3 AND day(earnings_date) < 10)
SELECT * FROM (SELECT max(earnings_date) AS last_event, count(*) AS events_total, count(*) FILTER (hour = 'amc') AS events_amc FROM ev),
(SELECT max(received_at) AS last_coverage, count(*) AS coverage_rows, count(*) FILTER (collection_mode = 'scheduled_capture') AS scheduled_rows, count(*) FILTER (collection_mode = 'historical_backfill') AS backfill_rows FROM cov),
(SELECT max(received_at) AS last_bar FROM pb JOIN cov ON {_ON('pb', 'cov')} AND pb.phase = cov.phase), (SELECT count(*) AS bar_rows FROM pb), (SELECT max(received_at) AS last_quote FROM tick),
(SELECT CAST(max(earnings_date) AS TIMESTAMP) + INTERVAL 1 DAY AS last_feature, count(*) AS feature_rows FROM lg)""",
    "chart_rows": f"{_U} SELECT symbol, earnings_date, reaction_class, round(initial_return, 6) AS initial_return, round(return_105m, 6) AS return_105m, round(retention, 6) AS retention FROM u ORDER BY u.earnings_date DESC, symbol LIMIT 2000",
    "export_rows": f"{_U} SELECT symbol, strftime(earnings_date, '%Y-%m-%d') AS earnings_date, analysis_status, round(eps_surprise_pct, 6) AS eps_surprise_pct, array_to_string(covered_phases, ';') AS covered_phases FROM u ORDER BY u.earnings_date DESC, symbol LIMIT 5000",
    "row_digests": f"""WITH {fx.DUCK_EVENTS} SELECT symbol, earnings_date, sha256('event-1' || chr(10) || '{{"earnings_date":"' || strftime(earnings_date, '%Y-%m-%d') || '","hour":"' || hour || '","k":' || k || ',"superseded":'
|| CASE WHEN k % 5 <> 0 THEN CAST(superseded AS VARCHAR) ELSE 'null' END || ',"symbol":"' || symbol || '"}}') AS sha256 FROM ev""",
    "bar_mode_violations": f"""WITH {fx.DUCK_EVENTS}, {fx.DUCK_BARS} SELECT symbol, earnings_date, phase, minute, id, CASE day(earnings_date) WHEN 8 THEN 'no_collection_mode' ELSE 'unknown_collection_mode' END AS rule FROM bar WHERE day(earnings_date) IN (8, 9)""",
    "path_levels": f"""{_ROW}, x AS (SELECT *, CASE WHEN reaction_direction = 'up' THEN 1 ELSE -1 END AS way FROM frow WHERE reference_price IS NOT NULL)
SELECT symbol, earnings_date, round(reference_price, 6) AS reference, round(reference_price * 102e-2, 6) AS upper, round(reference_price * 98e-2, 6) AS lower, round(reference_price * (1 + way * max_favorable_excursion / 100), 6) AS mfe_level,
round(reference_price * (1 + way * max_adverse_excursion / 100), 6) AS mae_level, round(reaction_vwap_proxy, 6) AS vwap, reaction_timestamp, feature_cutoff_ts FROM x""",
    "event_detail": f"""{_U}, dco AS (SELECT symbol, earnings_date, count(*) AS coverage, min(expected_start) AS first_coverage FROM cov GROUP BY ALL), dba AS (SELECT symbol, earnings_date, count(*) AS bars, min(ts) AS first_bars FROM fb GROUP BY ALL),
dno AS (SELECT symbol, earnings_date, count(*) AS notes, min(created_at) AS first_notes FROM note GROUP BY ALL)
SELECT u.symbol, u.earnings_date, u.analysis_status, coverage, first_coverage, bars, first_bars, notes, first_notes, CAST(length(f.parameters) AS INT) AS parameters FROM u LEFT JOIN dco ON {_ON('u', 'dco')} LEFT JOIN dba ON {_ON('u', 'dba')} LEFT JOIN dno ON {_ON('u', 'dno')} LEFT JOIN frow f ON {_ON('u', 'f')}""",
    "export_universe": f"""{_U} SELECT symbol, strftime(earnings_date, '%Y-%m-%d') AS earnings_date, round(eps_surprise_pct, 6) AS eps_surprise_pct, {_ISO('reaction_timestamp')} AS reaction_timestamp,
{', '.join(f"array_to_string({c}, ';') AS {c}" for c in ('data_quality_flags', 'missing_fields', 'covered_phases', 'missing_phases'))}, note_count FROM u""",
    "export_coverage": f"""{_BASE} SELECT symbol, strftime(earnings_date, '%Y-%m-%d') AS earnings_date, phase, {_ISO('expected_start')} AS expected_start, array_to_string(data_quality_flags, ';') AS data_quality_flags,
round(least(1, observed_minutes / expected_minutes), 6) AS coverage_ratio, CAST(greatest(expected_minutes - observed_minutes, 0) AS INT) AS missing_minutes FROM cov""",
    "phase_starts_eastern": f"""WITH {fx.DUCK_EVENTS}, {core._CAL}, ph AS (SELECT symbol, earnings_date, phase, CASE WHEN phase LIKE 'following%' THEN next ELSE earnings_date END AS market_date
  FROM ev JOIN cal ON day = earnings_date, (VALUES ('earnings_regular'), ('earnings_postmarket'), ('following_premarket'), ('following_regular')) v(phase))
SELECT symbol, earnings_date, phase, CAST(market_date AS TIMESTAMP) + CASE phase WHEN 'earnings_postmarket' THEN CASE WHEN early_close THEN 780 ELSE 960 END WHEN 'following_premarket' THEN 420 ELSE 570 END * INTERVAL 1 MINUTE AS start_eastern,
market_date AS end_date FROM ph JOIN cal ON day = market_date WHERE is_session""",
    "normalized_symbols": """WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' c' || c_custkey || ' ' WHEN 1 THEN 'c.' || c_custkey WHEN 2 THEN '1c' || c_custkey ELSE c_name END AS raw FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(upper(trim(raw)), '[A-Z][A-Z0-9.\\-]{0,9}') THEN upper(trim(raw)) END AS symbol FROM r""",
    "record_ages": f"WITH {fx.DUCK_TICKS} SELECT symbol, CAST(floor(epoch(TIMESTAMP '2030-01-01' - max(received_at))) AS BIGINT) AS age_seconds FROM tick GROUP BY ALL",
    "asof_daily": f"""WITH {fx.DUCK_EVENTS}, {fx.DUCK_DAILY} SELECT ev.symbol, earnings_date, CASE WHEN earnings_date - session_date <= 30 THEN session_date END AS session_date, CASE WHEN earnings_date - session_date <= 30 THEN volume END AS volume
FROM ev ASOF LEFT JOIN daily ON ev.symbol = daily.symbol AND ev.earnings_date >= daily.session_date""",
    "session_outcomes": f"{_SO} SELECT * REPLACE ({_R(_ORETURNS)}, {_J(['missing_fields', 'data_quality_flags'])}) FROM so",
    "asof_ticks": f"""WITH {fx.DUCK_TICKS}, l AS (SELECT symbol, event_timestamp, event_id FROM tick WHERE event_type = 'error'),
r AS (SELECT symbol, event_timestamp AS quoted_at, max(event_id) AS quote_id, arg_max(last, event_id) AS last FROM tick WHERE event_type <> 'error' AND last IS NOT NULL GROUP BY ALL)
SELECT l.symbol, event_timestamp, event_id, quoted_at, quote_id, round(last, 6) AS last FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.event_timestamp >= r.quoted_at""",
    "class_quantiles": _U + " " + " UNION ALL ".join(f"""SELECT '{c}' AS measure, reaction_class, count({c}) AS n, {', '.join(f'round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS q{i}' for i, p in ((1, 0.25), (2, 0.5), (3, 0.75)))}
FROM u WHERE {c} IS NOT NULL GROUP BY ALL""" for c in ("initial_return", "volume_105m")),
    "outcome_violations": f"""{_SO}, s0 AS (SELECT * FROM so WHERE analysis_status <> 'not_yet_available'), x AS ({_SPOILT}) SELECT symbol, earnings_date, unnest({_LIST(*_O_RULES)}) AS rule FROM x""",
    "outcome_parameters": f"""{_SO} SELECT symbol, earnings_date, outcome_version, source_evidence_sha256,
'{{"calendar":"XNYS","capture_grace_minutes":10,"execution_assumptions":"none","least_regular_coverage":0.95,"open_minutes":[5,30,60]}}' AS parameters FROM so
WHERE analysis_status <> 'not_yet_available' AND earnings_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""",
    "outcomes": f"{_SO} SELECT symbol, earnings_date, analysis_status, {_J(['missing_fields'])}, {_R(_OUTCOME)}, following_regular_observed_minutes, round(following_regular_coverage_ratio, 6) AS following_regular_coverage_ratio FROM so",
    "outcome_choice": f"""{_SO}, t AS (SELECT symbol, earnings_date, analysis_status AS status, regular_close_return, 'b' AS evidence_sha256 FROM so
  UNION ALL SELECT symbol, earnings_date, CASE WHEN day(earnings_date) < 15 THEN 'complete' ELSE 'insufficient_data' END, 0, 'a' FROM so)
SELECT symbol, earnings_date, status, evidence_sha256, round(regular_close_return, 6) AS regular_close_return FROM t
QUALIFY row_number() OVER (PARTITION BY symbol, earnings_date ORDER BY status <> 'complete', evidence_sha256) = 1""",
    "study_members": f"{_MEM} SELECT symbol, earnings_date, delay_minutes, round(metric, 6) AS metric, {_J(['reasons'])}, included, eligible FROM me WHERE study_key = 'S0' AND stage = 'development'",
    "study_result": f"{_DEV} SELECT {_RESULT.removeprefix('study_key, version, ')}, 'refine' AS decision FROM q_development WHERE study_key = 'S0'",
    "exclusion_counter": f"{_MEM} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM me WHERE study_key = 'S0' AND stage = 'development') GROUP BY ALL",
    "stored_outcomes": f"{_SO} SELECT symbol, earnings_date, outcome_version, source_evidence_sha256, analysis_status FROM so WHERE analysis_status <> 'not_yet_available' AND day(earnings_date) % 2 = 0",
    "outcome_run_summary": f"{_SO} SELECT {_SUMMARY('day(earnings_date) % 2 = 1')} FROM so",
    "all_study_members": f"{_MEM} SELECT study_key, version, stage, symbol, earnings_date, delay_minutes, round(metric, 6) AS metric, {_J(['reasons', 'flags'])}, included, eligible, feature_status, outcome_status, member_sha256 FROM me",
    "study_results": f"""{_OOS} SELECT 'development' AS stage, {_RESULT}, 'refine' AS decision FROM q_development UNION ALL SELECT 'oos', {_RESULT}, {_SEALED} FROM q_oos""",
    "cohort_digests": f"{_MEM}, {_ROOT} SELECT study_key, version, stage, members, sha256(members || ':' || s) AS cohort_sha256 FROM d3",
    "study_detail": f"""{_OOS} SELECT study_key, version, 0 AS part, NULL AS stage, NULL::INT AS generation, NULL::DATE AS earnings_date, NULL AS symbol, NULL::BOOLEAN AS included, NULL AS decision FROM plan
UNION ALL SELECT study_key, version, 1, 'development', 1, NULL, NULL, NULL, 'refine' FROM q_development UNION ALL SELECT study_key, version, 1, 'oos', 2, NULL, NULL, NULL, {_SEALED} FROM q_oos
UNION ALL SELECT study_key, version, 2, stage, CASE stage WHEN 'oos' THEN 2 ELSE 1 END, earnings_date, symbol, included, NULL FROM me""",
    "study_violations": f"""{_OOS}, q AS (SELECT *, 'refine' AS decision FROM q_development UNION ALL SELECT *, {_SEALED} FROM q_oos), b AS (SELECT *, CASE WHEN study_key LIKE '%5' THEN -1 ELSE threshold END AS t, excluded_count + CASE WHEN study_key LIKE '%3' THEN 1 ELSE 0 END AS x FROM q),
v AS (SELECT study_key, version, 'periods_overlap' AS rule FROM plan WHERE oos_from <= development_to AND development_from <= oos_to UNION ALL SELECT study_key, version, 'bad_threshold' FROM b WHERE t < 0
UNION ALL SELECT study_key, version, 'counts_differ' FROM b WHERE universe_count <> n + x UNION ALL SELECT study_key, version, 'promoted_past_gate' FROM b WHERE study_key LIKE '%4' AND NOT (sample_gate AND coverage_gate)
UNION ALL SELECT study_key, version, 'included_with_reasons' FROM me WHERE day(earnings_date) = 9 AND len(reasons) > 0
UNION ALL SELECT study_key, version, 'member_of_other_versions' FROM me WHERE day(earnings_date) = 13
UNION ALL SELECT study_key, version, 'no_assumptions' FROM b WHERE study_key LIKE '%6' UNION ALL SELECT study_key, version, 'no_limitations' FROM b WHERE study_key LIKE '%7' UNION ALL SELECT study_key, version, 'no_failure_modes' FROM b WHERE study_key LIKE '%8'
UNION ALL SELECT study_key, version, 'member_outside_period' FROM me WHERE day(earnings_date) = 11) SELECT study_key, version, rule, count(*) AS rows FROM v GROUP BY ALL""",
    "reconcile_window": f"{_RECON} SELECT * FROM rp",
    "unlisted_events": f"{_RECON} SELECT * FROM un",
    "live_after_reconcile": f"""{_RECON} SELECT ev.symbol, ev.earnings_date FROM ev LEFT JOIN rp ON {_ON('ev', 'rp')} WHERE hour = 'amc' AND NOT coalesce(rp.action = 'supersede', superseded)""",
    "liquidity_decisions": f"""{_ROW}, {fx.DUCK_DAILY}, t AS (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) <= 10), l AS (SELECT symbol, CAST(avg(close * volume) AS DOUBLE) AS dv FROM t GROUP BY ALL)
SELECT ev.symbol, ev.earnings_date, CASE WHEN dv IS NULL THEN 'inconclusive' WHEN dv < {core.FLOOR} THEN 'exclude' ELSE 'keep' END AS decision,
CASE WHEN dv < {core.FLOOR} THEN 'mean dollar volume ' || printf('%.0f', dv) || ' is under {core.FLOOR}' END AS reason FROM ev JOIN frow f ON {_ON('ev', 'f')} LEFT JOIN l ON l.symbol = ev.symbol WHERE NOT illiquid AND analysis_status = 'insufficient_data'""",
    "first_listed": f"WITH {fx.DUCK_EVENTS} SELECT symbol, earnings_date AS date, k * 10 + 1 AS eps_estimate FROM ev WHERE hour = 'amc'",
    "stale_watchlists": f"""WITH {fx.DUCK_EVENTS}, {core._CAL}, l AS (SELECT symbol, CASE WHEN max(k) % 7 <> 0 THEN max(earnings_date) END AS as_of FROM ev WHERE earnings_date <= DATE '{NOW[:10]}' GROUP BY symbol)
SELECT symbol, as_of, latest AS latest_session, coalesce(as_of < latest, TRUE) AS stale FROM l, cal WHERE day = DATE '{NOW[:10]}'""",
    "monitor_candidates": f"WITH {fx.DUCK_EVENTS} SELECT symbol, earnings_date, CAST(row_number() OVER (PARTITION BY earnings_date ORDER BY symbol) AS INT) AS place FROM ev WHERE hour = 'amc' AND NOT illiquid AND NOT superseded",
}
