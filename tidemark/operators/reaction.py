"""Reaction features: one plan, one shuffle on the event, over all events at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bar_problem, first_reason, pct_change

KEY = ("symbol", "earnings_date")

#: Thresholds and horizons (fixed values).
THRESHOLD_PCT, DELAYED_MINUTES, LEAST_BARS, MOST_CARRY = 2.0, 15, 5, 10
HORIZONS = (1, 5, 15, 30, 60, 105)
WINDOW = HORIZONS[-1]


def _post(c: Column | None = None) -> Column:
    inside = (F.col("phase") == "earnings_postmarket") & F.col("minute").between(0, WINDOW - 1)
    return inside if c is None else F.when(inside, c)


def with_reference(bars: DataFrame) -> DataFrame:
    """bars with `ref`, the close of minute -1, and `cr`, the percent change of a window bar's close."""
    w = Window.partitionBy(*KEY)
    ref = F.max(F.when((F.col("phase") == "earnings_regular") & (F.col("minute") == -1), F.col("close"))).over(w)
    return bars.withColumn("ref", ref).withColumn("cr", _post(pct_change(F.col("ref"), F.col("close"))))


def with_signal(bars: DataFrame, threshold: float = THRESHOLD_PCT) -> DataFrame:
    """with_reference() and `trigger`, the first window minute whose close moved by threshold or more."""
    w = Window.partitionBy(*KEY)
    return with_reference(bars).withColumn("trigger", F.min(F.when(F.abs("cr") >= threshold, F.col("minute"))).over(w))


def first_cross(bars: DataFrame, threshold: float = THRESHOLD_PCT) -> DataFrame:
    """Per event: the trigger minute, the minute its signal is available, and the return at it (null without a cross)."""
    s = with_signal(bars, threshold).filter(_post())
    at = F.col("minute") == F.col("trigger")
    return s.groupBy(*KEY).agg(F.min("trigger").alias("trigger_minute"), (F.min("trigger") + 1).alias("signal_minute"), F.max(F.when(at, F.col("cr"))).alias("initial_return"))


def checkpoints(bars: DataFrame, horizons: Sequence[int] = HORIZONS, most_carry: int = MOST_CARRY) -> DataFrame:
    """Long form: for each event and horizon the last window close at or before it, its age, and whether it is usable.

    Horizons are fixed, so the as-of join is a conditional aggregate: no join and no sort."""
    b = bars.filter(_post()).groupBy(*KEY).agg(*[F.max_by(F.struct("minute", "close"), F.when(F.col("minute") < h, F.col("minute"))).alias(f"_{h}") for h in horizons])
    # max_by skips rows whose ordering is null
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_{h}.close").alias("close"), (F.lit(h - 1) - F.col(f"_{h}.minute")).alias("age")) for h in horizons])
    out = b.select(*KEY, F.explode(rows).alias("c")).select(*KEY, "c.*")
    usable = F.coalesce(F.col("age") <= most_carry, F.lit(False))
    return out.select(*KEY, "horizon", F.when(usable, F.col("close")).alias("close"), F.when(usable, F.col("age")).alias("age"), usable.alias("usable"))


def vwap(high: Column, low: Column, close: Column, volume: Column, where: Column) -> Column:
    """Volume-weighted typical price of the rows where the condition holds; null without volume."""
    v = F.when(where & (volume > 0), volume)
    return F.sum((high + low + close) / 3 * v) / F.nullif(F.sum(v), F.lit(0))


def repeat_marks(bars: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """bars with `again`: whether another bar of the event has the phase and minute before it in the order."""
    w = Window.partitionBy(*key).orderBy("phase", "minute")
    at = F.struct("phase", "minute")
    return bars.withColumn("again", F.coalesce(F.lag(at).over(w) == at, F.lit(False)))


#: Bars as rows, or a function that unfolds them: given values of the events (None: none), the bars with these values in further columns; given the first and
#: last minute too (columns that may read values), only the bars of these minutes.
Bars = DataFrame | Callable[..., DataFrame]


def with_direction(bars: Bars, threshold: float) -> DataFrame:
    """Bars with `ref`, `cr`, `trigger`, `first_change` (the largest change at the trigger) and `dir`, its sign.

    Of rows by windows on the event. Bars that are unfolded are read again for each of these instead, only the minutes that can matter, and each time only the values of the
    events are joined: no bar is sorted."""
    w = Window.partitionBy(*KEY)
    if not callable(bars):
        s = with_signal(bars, threshold).withColumn("first_change", F.max(F.when(F.col("minute") == F.col("trigger"), F.col("cr"))).over(w))
        return s.withColumn("dir", F.signum("first_change"))
    cr = _post(pct_change(F.col("ref"), F.col("close")))
    only = lambda a, z: (F.lit(a), F.lit(z))
    ref = bars(None, only(-1, -1)).filter((F.col("phase") == "earnings_regular") & (F.col("minute") == -1)).groupBy(*KEY).agg(F.max("close").alias("ref"))
    hits = bars(ref, only(0, WINDOW - 1)).filter(F.abs(cr) >= threshold).groupBy(*KEY).agg(F.max("ref").alias("ref"), F.min("minute").alias("trigger"))
    first = bars(hits, (F.col("trigger"), F.col("trigger"))).filter(_post() & (F.col("minute") == F.col("trigger"))).groupBy(*KEY).agg(F.max("trigger").alias("trigger"), F.max(cr).alias("first_change"))
    return bars(ref.join(first, list(KEY), "left").withColumn("dir", F.signum("first_change"))).withColumn("cr", cr)


def minute_bits(minute: Column, most: int) -> list[Column]:
    """Aggregates that note the minutes 0 to most - 1 as bits, 64 in each; bits_count() counts them. A set of fixed size, unlike a list of minutes."""
    return [F.bit_or(F.when((minute >= a) & (minute < a + 64), F.call_function("shiftleft", F.lit(1).cast("long"), minute - a))) for a in range(0, most, 64)]


def bits_count(bits: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.bit_count(b), F.lit(0)) for b in bits])


def rows_of(bars: Bars) -> DataFrame:
    return bars(None) if callable(bars) else bars


def repeats_in(phase: str, first: int, minutes: int) -> Column:
    """Aggregate: rows of a phase less its different minutes, without an order of rows. Minutes outside of first and so many after it are refused, so none is missed."""
    own, place = F.col("phase") == phase, F.col("minute") - first
    known = F.when(place.between(0, minutes - 1), 1).otherwise(F.raise_error(F.lit(f"a bar lies outside of the minutes of {phase}")).cast("int"))
    return F.count(F.when(own, known)) - bits_count(minute_bits(F.when(own, place), minutes))


def path_measures(header: DataFrame, bars: Bars, threshold: float, horizons: Sequence[int], gates: Callable[[Callable], Column], extra: Sequence[Column] = (), repeats: bool = True, spans: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """header's events with everything that is measured on their bars, the first gate that fails (`hard`), `reason` and `reaction_class`.

    gates: given n (a column, null as 0), the code of the first failed gate. extra: aggregates for it, of numbers or truth values (texts would make Spark sort the bars).
    repeats: count repeated_bars for it too; this needs rows in order. Bars that are unfolded are not ordered: spans gives each phase's first minute and how many it has, for repeats_in()."""
    s = with_direction(bars, threshold)
    s = repeat_marks(s) if repeats and not callable(bars) else s
    again = [sum((repeats_in(p, *span) for p, span in spans.items()), F.lit(0)) if callable(bars) else F.count(F.when(F.col("again"), 1))] if repeats else []
    hr, lr = pct_change(F.col("ref"), F.col("high")), pct_change(F.col("ref"), F.col("low"))
    after = _post() & (F.col("minute") > F.col("trigger"))
    best = F.greatest(F.col("dir") * hr, F.col("dir") * lr)
    worst = F.least(F.col("dir") * hr, F.col("dir") * lr)
    from_signal = _post() & (F.col("minute") >= F.col("trigger"))
    upto = lambda h: _post(F.when(F.col("minute") < h, F.col("minute")))
    bad = bar_problem(*[F.col(c) for c in ("open", "high", "low", "close", "volume")]).isNotNull()
    bad_in = lambda p: F.coalesce(F.bool_or(bad & (F.col("phase") == p)), F.lit(False))
    seen = minute_bits(_post(F.col("minute")), WINDOW)
    aggs = [
        F.max("ref").alias("pre_close"), F.max("trigger").alias("trigger"), F.max("dir").alias("dir"), F.max("first_change").alias("initial_return"),
        F.count(_post(F.lit(1))).alias("post_bars"), bits_count(seen).alias("observed_minutes"),
        F.count(F.when(F.col("phase") == "earnings_regular", 1)).alias("regular_bars"), F.count("*").alias("bars"), *[a.alias("repeated_bars") for a in again],
        F.when(bad_in("earnings_regular"), "earnings_regular").when(bad_in("earnings_postmarket"), "earnings_postmarket").when(F.bool_or(bad), "other").alias("bad_phase"),
        F.max(_post(hr)).alias("high_return"), F.min(_post(lr)).alias("low_return"),
        vwap(F.col("high"), F.col("low"), F.col("close"), F.col("volume"), _post()).alias("vwap"),
        F.max(F.when(after, best)).alias("best_after"), F.min(F.when(after, worst)).alias("worst_after"), F.count(F.when(after, 1)).alias("bars_after"),
        F.max_by("cr", _post(F.col("minute"))).alias("terminal"),
        F.bool_or(from_signal & (F.col("cr") >= threshold)).alias("was_up"), F.bool_or(from_signal & (F.col("cr") <= -threshold)).alias("was_down"), *extra,
    ]
    for h in horizons:
        aggs += [F.max(upto(h)).alias(f"_at_{h}"), F.max_by("cr", upto(h)).alias(f"_return_{h}"), F.sum(F.when(upto(h).isNotNull(), F.col("volume"))).alias(f"volume_{h}m")]
    f = header.join(s.groupBy(*KEY).agg(*aggs), list(KEY), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    for h in horizons:
        f = f.withColumn(f"return_{h}m", F.when(F.col(f"_at_{h}") >= h - 1 - MOST_CARRY, F.col(f"_return_{h}")))
    missing = F.array_compact(F.array(*[F.when(F.col(f"return_{h}m").isNull(), F.lit(f"{h}m")) for h in horizons]))
    f = f.withColumn("observed_minutes", n("observed_minutes").cast("int")).withColumn("hard", gates(n))
    soft = F.when(F.size(missing) > 0, F.concat(F.lit(f"no checkpoint bar within {MOST_CARRY}m for: "), F.array_join(missing, ", "))).when(F.col("vwap").isNull(), "vwap_missing")
    late = F.when(F.col("trigger").isNotNull() & (n("bars_after") == 0), "trigger_on_last_bar")
    f = f.withColumn("reason", F.coalesce("hard", soft, late))
    ok, found = F.col("reason").isNull(), F.col("trigger").isNotNull()
    mfe = F.greatest(F.lit(0.0), F.col("dir") * F.col("initial_return"), F.col("best_after"))
    mae = F.least(F.lit(0.0), F.col("dir") * F.col("initial_return"), F.col("worst_after"))
    f = f.withColumn("mfe", F.when(ok & found, mfe)).withColumn("mae", F.when(ok & found, mae))
    f = f.withColumn("retracement", F.when(F.col("mfe") > 0, F.greatest(F.lit(0.0), (F.col("mfe") - F.col("dir") * F.col("terminal")) / F.col("mfe") * 100)))
    kind = (
        F.when(~ok, "insufficient_data").when(~found, "no_trigger_in_window").when(F.col("was_up") & F.col("was_down"), "whipsaw")
        .when(F.col("retracement") > 50, "spike_and_fade").when(F.col("trigger") + 1 >= DELAYED_MINUTES, "delayed_breakout").otherwise("immediate_continuation")
    )
    return f.withColumn("reaction_class", kind)


def measured_columns(horizons: Sequence[int] = HORIZONS) -> list[Column]:
    """Of path_measures() what a result shows: partial numbers where no gate failed, the path's where a signal was found."""
    ok, found = F.col("reason").isNull(), F.col("trigger").isNotNull()
    keep = lambda c: F.when(F.col("hard").isNull(), F.col(c)).alias(c)
    full = lambda c, name: F.when(ok & found, c).alias(name)
    return [
        "reaction_class", "reason", full(F.when(F.col("dir") > 0, "up").otherwise("down"), "direction"), keep("pre_close"),
        *[keep(f"return_{h}m") for h in horizons], *[keep(f"volume_{h}m") for h in horizons], keep("high_return"), keep("low_return"), keep("vwap"),
        full(F.col("initial_return"), "initial_return"), full(F.col("trigger") + 1, "delay_minutes"), "mfe", "mae", "retracement", "observed_minutes",
    ]


def reaction_features(header: DataFrame, bars: Bars, threshold: float = THRESHOLD_PCT, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row per event of header (symbol, earnings_date, post_covered, stale, early_close).

    bars: symbol, earnings_date, phase, minute (0 at the close), open, high, low, close, volume, as rows or unfolded. Events that fail a gate are
    `insufficient_data` with the first reason; those without a checkpoint or volume keep their partial numbers.
    evidence.evidence_features() does the same from coverage rows, with all gates.
    """
    gates = lambda n: first_reason(
        (~F.col("post_covered"), "phase_not_covered"), (F.col("stale"), "stale_retrieval"), (F.col("early_close"), "early_close"), (F.col("bad_phase").isNotNull(), "invalid_bar"),
        (n("post_bars") > n("observed_minutes"), "duplicate_timestamp"), (n("regular_bars") == 0, "no_regular_bars"), (n("post_bars") < LEAST_BARS, "too_few_bars"),
        (F.col("pre_close").isNull(), "reference_close_missing"),
    )
    f = path_measures(header.select(*KEY, "post_covered", "stale", "early_close"), bars, threshold, horizons, gates, repeats=False)
    return f.select(*KEY, *measured_columns(horizons))
