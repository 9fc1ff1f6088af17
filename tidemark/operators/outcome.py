"""Following-session outcomes: one conditional aggregate over all phases of an event."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bar_problem, pct_change, reasons
from .evidence import with_bar_texts
from .reaction import KEY, Bars, repeat_marks, repeats_in, rows_of

#: Minutes after the open that are priced exactly, and the least share of regular minutes (fixed values).
OPEN_MINUTES, LEAST_COVERAGE = (5, 30, 60), 0.95


#: Minutes after the following close until which an outcome may still come (fixed value); the version of stored outcomes.
CAPTURE_GRACE = 10
OUTCOME_VERSION = "outcome-1"

#: Prices that a complete outcome has, and the phases that it reads with their usual minutes (fixed values).
_NEEDED = ("reference_close", "reference_close_ts", "premarket_first", "premarket_high", "premarket_low", "premarket_last", "regular_open", "regular_high", "regular_low", "regular_close", *[f"regular_return_{n}m" for n in OPEN_MINUTES])
_PHASES = {"regular": ("earnings_regular", 390), "premarket": ("following_premarket", 150), "following_regular": ("following_regular", 390)}
PHASES = tuple(p for p, _ in _PHASES.values())


def session_outcomes(events: DataFrame, coverage: DataFrame, bars: Bars, days: DataFrame, *, now: str) -> DataFrame:
    """One row per after-close event: prices, times and returns of its next session by the calendar, coverage of three phases, status, missing fields and flags.

    coverage, bars: as evidence.phase_bars() takes and gives them (repeats kept), bars as rows or unfolded. days: the calendar (one row a day). now: exchange wall clock, as text.
    `not_yet_available`: now is before the following close plus CAPTURE_GRACE, and that session has no coverage, or has not ended, or lacks minutes.
    """
    c = F.col
    b = rows_of(bars).filter(c("phase").isin(*[p for p, _ in _PHASES.values()])).withColumn("minute", c("from_start") if callable(bars) else F.timestamp_diff("MINUTE", c("expected_start"), c("ts")).cast("int"))
    b = b if callable(bars) else repeat_marks(b)
    twice = lambda p, minutes: repeats_in(p, 0, minutes) > 0 if callable(bars) else F.bool_or((c("phase") == p) & c("again"))
    ref, pre, reg = (c("phase") == p for p, _ in _PHASES.values())
    last = c("from_end") == -1 if callable(bars) else c("ts") == c("expected_end") - F.expr("INTERVAL 1 MINUTE")
    at = lambda cond, v: F.max(F.when(cond, c(v)))
    bad = bar_problem(c("open"), c("high"), c("low"), c("close")).isNotNull()
    a = b.groupBy(*KEY).agg(
        at(ref & last, "close").alias("reference_close"), at(ref & last, "ts").alias("reference_close_ts"),
        F.min_by(F.when(pre, c("open")), F.when(pre, c("ts"))).alias("premarket_first"), at(pre, "high").alias("premarket_high"), F.min(F.when(pre, c("low"))).alias("premarket_low"),
        F.max_by(F.when(pre, c("close")), F.when(pre, c("ts"))).alias("premarket_last"), F.min(F.when(pre, c("ts"))).alias("premarket_first_ts"), F.max(F.when(pre, c("ts"))).alias("premarket_last_ts"),
        at(reg & (c("minute") == 0), "open").alias("regular_open"), at(reg, "high").alias("regular_high"), F.min(F.when(reg, c("low"))).alias("regular_low"), at(reg & last, "close").alias("regular_close"),
        *[at(reg & (c("minute") == n - 1), "close").alias(f"_close_{n}") for n in OPEN_MINUTES],
        *[F.bool_or((c("phase") == p) & bad).alias(f"_bad_{s}") for s, (p, _) in _PHASES.items()], *[twice(p, minutes).alias(f"_twice_{s}") for s, (p, minutes) in _PHASES.items()],
    )
    pick = lambda p, v: F.max(F.when(c("phase") == p, c(v)))
    names = {"observed_minutes": "observed_minutes", "expected_minutes": "expected_minutes", "expected_end": "_end", "response_sha256": "response_sha256", "collection_mode": "collection_mode", "data_quality_flags": "_flags"}
    cov = coverage.groupBy(*KEY).agg(*[pick(p, v).alias(f"{s}_{n}") for s, (p, _) in _PHASES.items() for v, n in names.items()])
    nxt = days.select(c("day").alias("earnings_date"), c("next").alias("_following"))
    shut = days.select(c("day").alias("_following"), F.when(c("early_close"), 780).otherwise(960).alias("_shut"))
    o = events.filter("hour = 'amc'").select(*KEY).join(F.broadcast(nxt), "earnings_date").join(F.broadcast(shut), "_following").join(cov, list(KEY), "left").join(a, list(KEY), "left")
    o = o.withColumn("available_after", c("_following").cast("timestamp_ntz") + F.make_dt_interval(mins=c("_shut") + CAPTURE_GRACE))
    for name in ("premarket_first", "premarket_high", "premarket_low", "premarket_last", "regular_open", "regular_high", "regular_low", "regular_close"):
        o = o.withColumn(f"{name}_return", pct_change(c("reference_close"), c(name)))
    for n in OPEN_MINUTES:
        o = o.withColumn(f"regular_return_{n}m", pct_change(c("reference_close"), c(f"_close_{n}")))
    there = {s: c(f"{s}_observed_minutes").isNotNull() for s in _PHASES}
    ratio = {s: F.when(there[s], F.least(F.lit(1.0), c(f"{s}_observed_minutes") / c(f"{s}_expected_minutes"))).otherwise(0.0) for s in _PHASES}
    phase = {s: p for s, (p, _) in _PHASES.items()}
    broken = [*[(c(f"_bad_{s}"), f"{phase[s]}_invalid_bar") for s in _PHASES], *[(c(f"_twice_{s}"), f"{phase[s]}_duplicate_timestamp") for s in _PHASES]]
    missing = reasons(*[(c(n).isNull(), n) for n in _NEEDED], *[(there[s] & (ratio[s] < LEAST_COVERAGE), f"{phase[s]}_coverage") for s in ("regular", "following_regular")], *broken)
    o = o.withColumn("_missing", missing)
    wall, reg_s = F.lit(now).cast("timestamp_ntz"), "following_regular"
    open_ = (wall < c("available_after")) & (~there[reg_s] | (wall < c(f"{reg_s}__end")) | (c(f"{reg_s}_observed_minutes") < c(f"{reg_s}_expected_minutes")))
    status = F.when(F.coalesce(open_, F.lit(False)), "not_yet_available").when(F.size("_missing") > 0, "insufficient_data").otherwise("complete")
    why = F.when(status == "not_yet_available", "session_not_complete").when(status == "insufficient_data", "evidence_missing")
    none = F.array().cast("array<string>")
    flags = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(c(f"{s}__flags"), none) for s in _PHASES], reasons(*broken))))
    absent = reasons(*[(~there[s], phase[s]) for s in _PHASES])
    values = ["reference_close", "reference_close_ts", "premarket_first", "premarket_first_ts", "premarket_high", "premarket_low", "premarket_last", "premarket_last_ts", "regular_open", "regular_high", "regular_low", "regular_close"]
    returns = [f"{n}_return" for n in ("premarket_first", "premarket_high", "premarket_low", "premarket_last", "regular_open", "regular_high", "regular_low", "regular_close")] + [f"regular_return_{n}m" for n in OPEN_MINUTES]
    cover = [x for s, (_, minutes) in _PHASES.items() for x in (
        F.coalesce(f"{s}_observed_minutes", F.lit(0)).alias(f"{s}_observed_minutes"), F.coalesce(f"{s}_expected_minutes", F.lit(minutes)).alias(f"{s}_expected_minutes"), ratio[s].alias(f"{s}_coverage_ratio"),
        f"{s}_response_sha256", f"{s}_collection_mode",
    )]
    return o.select(
        *KEY, F.lit(OUTCOME_VERSION).alias("outcome_version"), status.alias("analysis_status"), why.alias("analysis_status_reason"), *values, *returns, c("regular_open_return").alias("overnight_gap_return"), *cover,
        F.array_sort(F.array_distinct(F.concat(absent, "_missing"))).alias("missing_fields"), flags.alias("data_quality_flags"), "available_after",
    )


def with_outcome_digest(outcomes: DataFrame, coverage: DataFrame, bars: Bars) -> DataFrame:
    """session_outcomes() with source_evidence_sha256: of everything that the three phases' coverage says of itself, and every bar of them, in order.

    A changed price, volume, time, bound, flag or identity of any phase changes it; the order of rows does not.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    minute = lambda c: F.coalesce(F.date_format(c, "yyyyMMddHHmm"), F.lit("-"))
    flags = F.array_join(F.array_sort(F.array_distinct(F.coalesce("data_quality_flags", F.array().cast("array<string>")))), ",")
    head = F.concat_ws("|", "phase", F.date_format("market_date", "yyyy-MM-dd"), "session", minute("expected_start"), minute("expected_end"), known("observed_minutes"), known("expected_minutes"), known("source"), minute("received_at"), known("response_sha256"), known("collection_mode"), flags)
    three = F.col("phase").isin(*[p for p, _ in _PHASES.values()])
    heads = coverage.filter(three).select(*KEY, head.alias("_heads")).groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_list("_heads")), "\n").alias("_heads"))
    o = with_bar_texts(outcomes.join(heads, list(KEY), "left"), bars, PHASES, "_rows")
    text = F.concat_ws("\n", "symbol", F.date_format("earnings_date", "yyyy-MM-dd"), F.coalesce("_heads", F.lit("")), F.coalesce("_rows", F.lit("")))
    return o.withColumn("source_evidence_sha256", F.sha2(text, 256)).drop("_heads", "_rows")


def parameters() -> Column:
    """The definition that an outcome was made under, as JSON with sorted keys (fixed values)."""
    p = {"calendar": "XNYS", "capture_grace_minutes": CAPTURE_GRACE, "execution_assumptions": "none", "least_regular_coverage": LEAST_COVERAGE, "open_minutes": list(OPEN_MINUTES)}
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    return F.to_json(F.struct(*[lit(v).alias(k) for k, v in sorted(p.items())]))


#: Days that one run may span (fixed value).
MOST_DAYS = 370


def outcomes_to_store(outcomes: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """with_outcome_digest() without what is not available yet, with its parameters; the ledger's key is event, version and digest.

    start, end: the events' first and last date, MOST_DAYS apart at most; a longer run is refused."""
    if start is not None and end is not None:
        if not 0 <= (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days <= MOST_DAYS:
            raise ValueError(f"a run spans {MOST_DAYS} days at most")
        outcomes = outcomes.filter(F.col("earnings_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return outcomes.filter("analysis_status <> 'not_yet_available'").withColumn("parameters", parameters())


def outcome_violations(rows: DataFrame) -> DataFrame:
    """event and rule of each stored outcome that breaks a rule of its table: what a status must have or lack, pairs of identity and mode, minutes seen
    against minutes expected, digests and modes. A rule that asks a null is broken only where it says so."""
    c = F.col
    filled = sum((c(n).isNotNull().cast("int") for n in _NEEDED), F.lit(0))
    lists = F.coalesce(F.size("missing_fields"), F.lit(0))
    status, why = c("analysis_status"), c("analysis_status_reason")
    sha = lambda n: c(n).isNotNull() & ~c(n).rlike("^[0-9a-f]{64}$")
    each = [rule for s in _PHASES for rule in (
        (c(f"{s}_response_sha256").isNull() != c(f"{s}_collection_mode").isNull(), f"{s}_identity_unpaired"), (c(f"{s}_observed_minutes") > c(f"{s}_expected_minutes"), f"{s}_minutes_exceed"),
        (sha(f"{s}_response_sha256"), f"{s}_bad_response_digest"), (~c(f"{s}_collection_mode").isin("scheduled_capture", "historical_backfill"), f"{s}_unknown_mode"),
    )]
    rules = [
        ((status == "complete") & ~(why.isNull() & (lists == 0) & (filled == len(_NEEDED))), "complete_row_incomplete"),
        ((status == "insufficient_data") & ~(why.isNotNull() & (lists > 0)), "insufficient_data_row_incomplete"), (~F.coalesce(status.isin("complete", "insufficient_data"), F.lit(False)), "unknown_status"),
        (F.coalesce(sha("source_evidence_sha256"), F.lit(True)) | c("source_evidence_sha256").isNull(), "bad_evidence_digest"), *each,
    ]
    return rows.select(*KEY, F.explode(reasons(*rules)).alias("rule"))


def read_outcomes(stored: DataFrame, version: str = OUTCOME_VERSION) -> DataFrame:
    """Stored outcomes of a version in reading order: by event, complete ones first, then the newest, then by digest."""
    by = ["earnings_date", "symbol", (F.col("analysis_status") != "complete").cast("int"), F.desc("computed_at"), "source_evidence_sha256"]
    return stored.filter(F.col("outcome_version") == version).orderBy(*by)
