"""Evidence of events: which retrieval is authoritative, its bars, features under all gates, and rows to store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_reason, merge_flags, reasons, retention, stale_is_fatal, surprise_pct
from .bars import latest_per_key
from .reaction import DELAYED_MINUTES, HORIZONS, KEY, LEAST_BARS, MOST_CARRY, THRESHOLD_PCT, WINDOW, Bars, measured_columns, path_measures, rows_of

#: Phases of an event's two days, in order; those that features read; flags that rule features out (fixed values).
PHASES = ("earnings_regular", "earnings_postmarket", "following_premarket", "following_regular")
STUDY_PHASES = PHASES[:2]
FATAL_FLAGS = ("duplicate_minute_bars", "no_bars_in_requested_phase", "no_bars_returned")
ENDPOINT = "/v1/session-history"
#: Minutes of both study phases as minutes_of() counts them: the first, and how many there are at most, after an early close (fixed values).
STUDY_MINUTES = {STUDY_PHASES[0]: (-390, 390), STUDY_PHASES[1]: (0, 420)}

#: The versions that a stored feature row is of (fixed values of this library).
VERSIONS = ("features-1", "detector-1", "classifier-1")
VERSION_COLUMNS = ("feature_version", "detector_version", "classifier_version")
LIVE_KEY = (*KEY, *VERSION_COLUMNS)


def phase_bars(coverage: DataFrame, bars: DataFrame, endpoint: str = ENDPOINT) -> DataFrame:
    """Bars of the retrieval that each coverage row names, inside its half-open bounds: an equi-join on symbol, session, date, time received and
    source, with the range as a residual condition. Bars of one time stay, all of them: first_of_each() keeps the first."""
    c = coverage.select("symbol", "earnings_date", "phase", "session", F.col("market_date").alias("evidence_date"), "received_at", "source", "expected_start", "expected_end")
    j = bars.filter(F.col("endpoint") == endpoint).join(c, ["symbol", "session", "evidence_date", "received_at", "source"])
    return j.filter((F.col("ts") >= F.col("expected_start")) & (F.col("ts") < F.col("expected_end")))


def first_of_each(bars: DataFrame) -> DataFrame:
    return latest_per_key(bars, [*KEY, "phase", "ts"], F.col("id").asc())


_HEADER = ("expected_start", "expected_end", "received_at", "source", "market_date", "collection_mode", "response_sha256")


def evidence_header(events: DataFrame, coverage: DataFrame) -> DataFrame:
    """After-close events with the bounds, times and identities of both study phases side by side, and the union of their flags."""
    pick = lambda p, c: F.max(F.when(F.col("phase") == p, F.col(c)))
    each = [pick(p, c).alias(f"{short}_{c}") for p, short in zip(STUDY_PHASES, ("regular", "post"), strict=True) for c in (*_HEADER, "data_quality_flags")]
    wide = coverage.filter(F.col("phase").isin(*STUDY_PHASES)).groupBy(*KEY).agg(*each)
    h = events.filter("hour = 'amc'").join(wide, list(KEY), "left")
    return h.withColumn("data_quality_flags", merge_flags(F.col("regular_data_quality_flags"), F.col("post_data_quality_flags"))).drop("regular_data_quality_flags", "post_data_quality_flags")


def minutes_of(bars: DataFrame) -> DataFrame:
    """phase_bars() with `minute`: from the phase's start, or in the regular phase from its end (-1 is its last). Bars that bring these as from_start and from_end keep them."""
    if "from_start" in bars.columns:
        return bars.withColumn("minute", F.when(F.col("phase") == "earnings_regular", F.col("from_end")).otherwise(F.col("from_start")))
    base = F.when(F.col("phase") == "earnings_regular", F.col("expected_end")).otherwise(F.col("expected_start"))
    return bars.withColumn("minute", F.timestamp_diff("MINUTE", base, F.col("ts")).cast("int"))


def evidence_features(header: DataFrame, bars: Bars, threshold: float = THRESHOLD_PCT, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Features of every event of evidence_header() under all gates, the first that fails being the reason; header's columns stay.

    bars: as phase_bars() gives them, of any phases, as rows or unfolded. data_quality_flags gain a flag for each checkpoint that an earlier bar stands for, and
    one where no volume was traded. source_bar_count counts the bars of both study phases.
    """
    of_study = lambda rows: minutes_of(rows.filter(F.col("phase").isin(*STUDY_PHASES)))
    b = (lambda *which: of_study(bars(*which))) if callable(bars) else of_study(bars)
    stale = lambda p: F.coalesce(F.bool_or((F.col("phase") == p) & F.col("stale")), F.lit(False))
    outside = (F.col("from_start") < 0) | (F.col("from_end") >= 0) if callable(bars) else (F.col("ts") < F.col("expected_start")) | (F.col("ts") >= F.col("expected_end"))
    extra = [stale(STUDY_PHASES[0]).alias("regular_stale"), stale(STUDY_PHASES[1]).alias("post_stale"), F.count(F.when(outside, 1)).alias("outside_bars")]
    c = F.col
    fatal = F.array_sort(F.array_intersect("data_quality_flags", F.array(*[F.lit(x) for x in FATAL_FLAGS])))
    bounds = [c(f"{p}_expected_{e}") for p in ("regular", "post") for e in ("start", "end")]
    wrong = (bounds[0] >= bounds[1]) | (bounds[2] >= bounds[3]) | (bounds[1] != bounds[2])
    stale_now = stale_is_fatal(c("regular_stale"), c("regular_received_at"), bounds[1]) | stale_is_fatal(c("post_stale"), c("post_received_at"), bounds[3])

    def gates(n) -> Column:
        return F.coalesce(
            first_reason(
                (c("regular_received_at").isNull() | c("post_received_at").isNull(), "phase_not_covered"), (bounds[0].isNull() | bounds[1].isNull() | bounds[2].isNull() | bounds[3].isNull(), "bounds_missing"),
                (wrong, "bounds_invalid"), (stale_now, "stale_retrieval"),
            ),
            F.when(F.size(fatal) > 0, F.concat(F.lit("fatal_flags: "), F.array_join(fatal, ","))),
            first_reason(
                ((F.hour(bounds[2]) != 16) | (F.minute(bounds[2]) != 0), "early_close"), (c("bad_phase") == STUDY_PHASES[0], "invalid_regular_bar"), (c("bad_phase") == STUDY_PHASES[1], "invalid_postmarket_bar"),
                (n("outside_bars") > 0, "bar_outside_bounds"), (n("repeated_bars") > 0, "duplicate_timestamp"), (bounds[2] + F.make_dt_interval(mins=F.lit(WINDOW)) > bounds[3], "coverage_ends_early"),
                (n("regular_bars") == 0, "no_regular_bars"), (n("post_bars") < LEAST_BARS, "too_few_bars"), (c("pre_close").isNull(), "reference_close_missing"),
            ),
        )

    f = path_measures(header, b, threshold, horizons, gates, extra, spans=STUDY_MINUTES)
    age = lambda h: F.lit(h - 1) - c(f"_at_{h}")
    carried = F.array_compact(F.array(*[F.when(age(h).between(1, MOST_CARRY), F.format_string(f"checkpoint_{h}m_carried_forward_%dm", age(h))) for h in horizons], F.when(c("vwap").isNull(), "volume_unavailable_for_vwap")))
    flags = F.when(c("hard").isNull(), merge_flags(c("data_quality_flags"), carried)).otherwise(c("data_quality_flags"))
    f = f.withColumn("data_quality_flags", flags).withColumn("source_bar_count", F.coalesce("bars", F.lit(0)))
    return f.select(*header.columns, "source_bar_count", *measured_columns(horizons))


#: Numbers of a stored row and the measured columns they come from; an insufficient row names those that are null (fixed values).
NUMBERS = {
    "reference_price": "pre_close", "initial_return": "initial_return", **{f"return_{h}m": f"return_{h}m" for h in HORIZONS}, "window_high_return": "high_return", "window_low_return": "low_return",
    "max_favorable_excursion": "mfe", "max_adverse_excursion": "mae", "max_retracement": "retracement", "reaction_vwap_proxy": "vwap", **{f"volume_{h}m": f"volume_{h}m" for h in HORIZONS},
}
COMPLETE = ("immediate_continuation", "spike_and_fade", "delayed_breakout", "whipsaw")


def parameters() -> Column:
    """The definition that a row was made under, as JSON with sorted keys (fixed values)."""
    p = {"calendar": "XNYS", "checkpoint_carry_minutes": MOST_CARRY, "delayed_minutes": DELAYED_MINUTES, "fade_retracement_pct": 50.0, "horizons": list(HORIZONS), "least_bars": LEAST_BARS, "threshold_pct": THRESHOLD_PCT, "window_minutes": WINDOW}
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    return F.to_json(F.struct(*[lit(v).alias(k) for k, v in sorted(p.items())]))


def feature_rows(features: DataFrame, versions: Sequence[str] = VERSIONS) -> DataFrame:
    """Rows to store of evidence_features(): status, class and direction, window and signal times, numbers, coverage, identities, flags, missing fields.

    features need source_evidence_sha256. The window's times are null where the coverage does not hold it."""
    c, kind = F.col, F.col("reaction_class")
    status = F.when(kind == "insufficient_data", "insufficient_data").when(kind == "no_trigger_in_window", "no_trigger_in_window").otherwise("complete")
    direction = F.when(kind == "no_trigger_in_window", "flat").when(kind != "insufficient_data", F.when(c("initial_return") > 0, "up").otherwise("down"))
    start, end = c("post_expected_start"), c("post_expected_end")
    cutoff = start + F.make_dt_interval(mins=F.lit(WINDOW))
    fits = (start < end) & (cutoff <= end)
    seen = F.least(c("observed_minutes"), F.lit(WINDOW))
    names = F.array_compact(F.array(*[F.when(c(source).isNull(), F.lit(name)) for name, source in NUMBERS.items()]))
    return features.select(
        *KEY, *[F.lit(v).alias(n) for n, v in zip(VERSION_COLUMNS, versions, strict=True)], status.alias("analysis_status"),
        F.coalesce("reason", F.when(kind == "no_trigger_in_window", "no_trigger_in_window")).alias("analysis_status_reason"), F.when(kind != "insufficient_data", kind).alias("reaction_class"), direction.alias("reaction_direction"),
        F.when(fits, start).alias("feature_window_start"), F.when(fits, end).alias("feature_window_end"), F.when(fits, cutoff).alias("feature_cutoff_ts"), F.when(fits, cutoff).alias("label_cutoff_ts"),
        (start + F.make_dt_interval(mins=c("delay_minutes"))).alias("reaction_timestamp"), c("delay_minutes").alias("detection_delay_minutes"), *[c(source).alias(name) for name, source in NUMBERS.items()],
        "source_bar_count", seen.alias("study_observed_minutes"), (F.lit(WINDOW) - seen).alias("study_missing_minutes"), (seen / F.lit(WINDOW)).alias("study_coverage_ratio"),
        c("regular_response_sha256").alias("earnings_regular_response_sha256"), c("regular_collection_mode").alias("earnings_regular_collection_mode"),
        c("post_response_sha256").alias("earnings_postmarket_response_sha256"), c("post_collection_mode").alias("earnings_postmarket_collection_mode"), "source_evidence_sha256", parameters().alias("parameters"), "data_quality_flags",
        F.when(kind == "insufficient_data", names).otherwise(F.array().cast("array<string>")).alias("missing_fields"),
    )


def stamp(ts: Column) -> Column:
    """Wall clock to the minute as a number, yyyyMMddHHmm, of years of four digits. ts: without a zone."""
    minutes = (F.unix_timestamp(ts) / 60).cast("long")  # of a time without a zone a mere division: fields of the clock would each be asked of a calendar
    day, minute = F.date_from_unix_date((minutes / 1440).cast("int")), minutes % 1440
    late = (F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).cast("long") * 10000 + minute + (minute / 60).cast("long") * 40
    return F.when(minutes > 0, late).otherwise(F.date_format(ts, "yyyyMMddHHmm").cast("long"))  # before 1970 seconds are cut towards it


def micro(price: Column) -> Column:
    """A price in millionths, a half away from zero, as text; one that is no number by its name."""
    x = price.cast("double")
    size = F.abs(x)
    y = size * 1_000_000  # of a product of size 2^52 or more nothing is left to round; below it the difference is exact
    whole = F.floor(y)
    near = whole + (y - whole >= 0.5).cast("int")
    return F.when(size <= 9e12, F.when(x < 0, -near).otherwise(near).cast("string")).otherwise(F.coalesce(x.cast("string"), F.lit("-")))  # NaN lies above all numbers


def bar_text() -> Column:
    """A bar as text: phase, time, prices in millionths, volume; a price that is no number by its name."""
    return F.concat_ws(":", "phase", stamp(F.col("ts")).cast("string"), *[micro(F.col(c)) for c in ("open", "high", "low", "close")], F.coalesce(F.col("volume").cast("string"), F.lit("-")))


def with_bar_texts(events: DataFrame, bars: Bars, phases: Sequence[str], name: str) -> DataFrame:
    """events with the texts of all their bars of some phases in order, a line each. An event's bars are bounded by its minutes, so the list of one event stays small.

    Texts are in the order in which bars are unfolded, so that sorting them is a look at each; parts of events are small (fixtures.EVENTS_PER_TEXTS_PART), so that one fits a task's memory."""
    lines = rows_of(bars).filter(F.col("phase").isin(*phases)).select(*KEY, bar_text().alias(name))  # ready-made, as collect_list works what it is given out without generated code
    b = lines.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_list(name)), "\n").alias(name))
    return events.join(b, list(KEY), "left")


def evidence_digests(header: DataFrame, bars: Bars) -> DataFrame:
    """SHA-256 of each event's authoritative evidence: response identities, bounds and every bar, in an order of their own."""
    known = lambda c: F.coalesce(c, F.lit("-"))
    ids = [known(F.col(f"{p}_response_sha256")) for p in ("regular", "post")] + [known(F.date_format(f"{p}_expected_{e}", "yyyyMMddHHmm")) for p in ("regular", "post") for e in ("start", "end")]
    h = with_bar_texts(header, bars, STUDY_PHASES, "rows")
    return h.select(*header.columns, F.sha2(F.concat_ws("\n", "symbol", F.date_format("earnings_date", "yyyy-MM-dd"), *ids, F.coalesce("rows", F.lit(""))), 256).alias("source_evidence_sha256"))


def live_features(features: DataFrame, retractions: DataFrame) -> DataFrame:
    """Stored rows without those that were retracted (event, versions and evidence)."""
    return features.join(retractions.select(*LIVE_KEY, "source_evidence_sha256"), [*LIVE_KEY, "source_evidence_sha256"], "left_anti")


def covered_phases(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy(*KEY).agg(F.sort_array(F.collect_set("phase")).alias("covered_phases"))


def live_scope(events: DataFrame) -> DataFrame:
    """Live after-close events with their EPS surprise: what studies choose their members from."""
    e = events.filter((F.col("hour") == "amc") & ~F.col("illiquid") & ~F.col("superseded"))
    return e.select(*KEY, surprise_pct(F.col("eps_actual"), F.col("eps_estimate")).alias("eps_surprise_pct"))


def universe(events: DataFrame, features: DataFrame, coverage: DataFrame, notes: DataFrame, start=None, end=None, symbols: Sequence[str] = (), versions: Sequence[str] = VERSIONS) -> DataFrame:
    """Live after-close events of a period (dates as text, either end open) and of symbols (none: all), with the live feature row of the version triple,
    surprises, retention, the phases covered and not, and the number of notes. features: without retracted rows (live_features())."""
    e = events.filter((F.col("hour") == "amc") & ~F.col("illiquid") & ~F.col("superseded"))
    for bound, side in ((start, lambda x: F.col("earnings_date") >= x), (end, lambda x: F.col("earnings_date") <= x)):
        e = e.filter(side(F.lit(bound).cast("date"))) if bound else e
    e = e.filter(F.col("symbol").isin(*symbols)) if symbols else e
    e = e.select(*KEY, "hour", "eps_estimate", "eps_actual", "revenue_estimate", "revenue_actual", "quarter", "year")
    same = [F.col(n) == F.lit(v) for n, v in zip(VERSION_COLUMNS, versions, strict=True)]
    f = features.filter(same[0] & same[1] & same[2]).drop("feature_window_start", "feature_window_end", "feature_cutoff_ts", "label_cutoff_ts", "parameters", "source_bar_count")
    count = notes.groupBy(*KEY).agg(F.count("*").cast("int").alias("note_count"))
    u = e.join(f, list(KEY), "left").join(covered_phases(coverage), list(KEY), "left").join(count, list(KEY), "left")
    none, every = F.array().cast("array<string>"), F.array(*[F.lit(p) for p in PHASES])
    u = u.withColumns({
        "eps_surprise_pct": surprise_pct(F.col("eps_actual"), F.col("eps_estimate")), "revenue_surprise_pct": surprise_pct(F.col("revenue_actual"), F.col("revenue_estimate")),
        "retention": retention(F.col("return_105m"), F.col("initial_return")), "covered_phases": F.coalesce("covered_phases", none), "note_count": F.coalesce("note_count", F.lit(0)),
        "data_quality_flags": F.coalesce("data_quality_flags", none), "missing_fields": F.coalesce("missing_fields", none),
    })
    missing = F.array_except(every, F.col("covered_phases"))
    return u.withColumn("missing_phases", missing).withColumn("study_ready", ~F.arrays_overlap(F.array(*[F.lit(p) for p in STUDY_PHASES]), missing))


#: Minutes after a phase's end from which it is overdue (fixed value).
CAPTURE_GRACE = 10


def quality_issues(u: DataFrame, days: DataFrame, now: str) -> DataFrame:
    """At most one issue an event of universe(): the first of the ordered list that applies; none while a study phase may still be captured.

    days: the calendar (one row a day). now: exchange wall clock, as text. observed and expected minutes go with issues about features."""
    wall = lambda m: F.col("earnings_date").cast("timestamp_ntz") + F.make_dt_interval(mins=m + CAPTURE_GRACE)
    x = u.join(F.broadcast(days.select(F.col("day").alias("earnings_date"), F.col("early_close").alias("_short"))), "earnings_date", "left")
    due = {STUDY_PHASES[0]: wall(F.when(F.col("_short"), 780).otherwise(960)), STUDY_PHASES[1]: wall(F.lit(1200))}
    lacks = lambda p: ~F.array_contains("covered_phases", p)
    late = reasons(*[(lacks(p) & (F.lit(now).cast("timestamp_ntz") >= due[p]), p) for p in STUDY_PHASES])
    x = x.withColumn("late", late).withColumn("pending", (F.size("late") == 0) & (lacks(STUDY_PHASES[0]) | lacks(STUDY_PHASES[1])))
    modes = [F.coalesce(F.col(f"{p}_collection_mode"), F.lit("")) for p in STUDY_PHASES]
    kind = (
        F.when(F.size("late") > 0, "missing_capture_phase").when(F.col("pending"), None).when(F.col("analysis_status").isNull(), "not_analyzed").when(F.col("analysis_status") == "insufficient_data", "insufficient_data")
        .when((modes[0] == "historical_backfill") | (modes[1] == "historical_backfill"), "historical_backfill").when(F.size("data_quality_flags") > 0, "data_quality_flag")
    )
    x = x.withColumn("kind", kind).filter("kind IS NOT NULL")
    of_features = F.col("kind").isin("insufficient_data", "historical_backfill", "data_quality_flag")
    detail = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in (
        ("missing_capture_phase", F.array_join("late", ", ")), ("insufficient_data", F.col("analysis_status_reason")), ("historical_backfill", F.concat_ws("/", *modes)), ("data_quality_flag", F.array_join("data_quality_flags", ", ")),
        ("not_analyzed", F.lit("/".join(VERSIONS))),
    )])
    missing = F.when(F.col("kind") == "missing_capture_phase", F.col("late")).when(of_features, F.col("missing_phases")).otherwise(F.array().cast("array<string>"))
    return x.select(*KEY, "kind", detail.alias("detail"), missing.alias("phases_missing"), F.when(of_features, F.col("study_observed_minutes")).alias("observed_minutes"), F.when(of_features, F.lit(WINDOW)).alias("expected_minutes"))


def feature_violations(rows: DataFrame) -> DataFrame:
    """event and rule of each stored feature row that breaks a rule of its table: order of times, pairs of identity and mode, and which
    columns a status must have or lack. A rule that asks a null is broken only where it says so."""
    c = F.col
    has, lacks = (lambda n: c(n).isNotNull()), (lambda n: c(n).isNull())
    filled = sum((c(n).isNotNull().cast("int") for n in NUMBERS), F.lit(0))
    window = has("feature_window_start") & has("feature_window_end") & has("feature_cutoff_ts") & has("label_cutoff_ts")
    shas = has("earnings_regular_response_sha256") & has("earnings_postmarket_response_sha256")
    signal = ("reaction_timestamp", "detection_delay_minutes", "initial_return", "max_favorable_excursion", "max_adverse_excursion", "max_retracement")
    no_signal = lacks(signal[0])
    for n in signal[1:]:
        no_signal = no_signal & lacks(n)
    same = lambda n, v: F.coalesce(c(n) == v, F.lit(False))
    good = {
        "complete": F.coalesce(c("reaction_class").isin(*COMPLETE) & c("reaction_direction").isin("up", "down"), F.lit(False)) & has("reaction_timestamp") & has("detection_delay_minutes")
        & lacks("analysis_status_reason") & window & shas & (filled == 20) & (F.size("missing_fields") == 0),
        "no_trigger_in_window": same("reaction_class", "no_trigger_in_window") & same("reaction_direction", "flat") & no_signal & has("analysis_status_reason") & window & shas & (filled == 16) & (F.size("missing_fields") == 0),
        "insufficient_data": lacks("reaction_class") & lacks("reaction_direction") & no_signal & has("analysis_status_reason") & (F.size("missing_fields") > 0),
    }
    sha = lambda n: has(n) & ~c(n).rlike("^[0-9a-f]{64}$")
    rules = [
        (c("feature_window_end") <= c("feature_window_start"), "window_reversed"), (c("feature_cutoff_ts") <= c("feature_window_start"), "cutoff_before_start"),
        (c("label_cutoff_ts") < c("feature_cutoff_ts"), "label_before_cutoff"), (c("label_cutoff_ts") > c("feature_window_end"), "label_after_window"), (F.trim("analysis_status_reason") == "", "blank_reason"),
        (lacks("earnings_regular_response_sha256") != lacks("earnings_regular_collection_mode"), "regular_identity_unpaired"),
        (lacks("earnings_postmarket_response_sha256") != lacks("earnings_postmarket_collection_mode"), "postmarket_identity_unpaired"),
        (~c("reaction_timestamp").between(c("feature_window_start"), c("feature_cutoff_ts")), "signal_outside_window"), (sha("source_evidence_sha256"), "bad_evidence_digest"),
        *[((c("analysis_status") == s) & ~ok, f"{s}_row_incomplete") for s, ok in good.items()], (~c("analysis_status").isin(*good), "unknown_status"),
    ]
    return rows.select(*KEY, F.explode(reasons(*rules)).alias("rule"))


#: How coverage comes about, and how bars do (fixed values).
COVERAGE_MODES = ("scheduled_capture", "historical_backfill")
BAR_MODES = ("legacy_unspecified", "manual_collection", "scheduled_capture", "historical_backfill")


def mode_violations(rows: DataFrame, key: Sequence[str], mode: str = "collection_mode", modes: Sequence[str] = COVERAGE_MODES) -> DataFrame:
    """key and rule of each row of coverage (of bars: modes=BAR_MODES) whose mode is absent or none of modes."""
    return rows.select(*key, F.explode(reasons((F.col(mode).isNull(), "no_collection_mode"), (~F.col(mode).isin(*modes), "unknown_collection_mode"))).alias("rule"))


def run_summary(computed: DataFrame, stored: DataFrame, key: Sequence[str] = LIVE_KEY) -> DataFrame:
    """One row: how many rows a run computed by status, and how many are new to the ledger or already there."""
    known = stored.select(*key).distinct().withColumn("_known", F.lit(True))
    j = computed.join(known, list(key), "left")
    by = lambda s: F.count_if(F.col("analysis_status") == s).alias(s)
    kept = F.col("analysis_status") != "not_yet_available"
    return j.agg(
        F.count("*").alias("scanned"), by("complete"), by("no_trigger_in_window"), by("insufficient_data"), by("not_yet_available"),
        F.count_if(kept & F.col("_known").isNull()).alias("inserted"), F.count_if(kept & F.col("_known").isNotNull()).alias("conflicted"),
    )
