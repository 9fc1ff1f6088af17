"""Results that must not change, and plans that must not grow, with the size of tables."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence as ev
from tidemark.operators import ledger, reaction
from tidemark.operators import outcome as oc
from tidemark.plans import events, operations, queries
from tidemark.sources import evidence as evx
from tidemark.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 2)


def nodes(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_liquidity_reasons_round_as_sql_does(spark):
    """42.5 and 42.49999999999999 are one mean summed in two orders; SQL's printf gives a half the even number."""
    events = spark.createDataFrame([(s, DAY, False) for s in "AB"], "symbol string, earnings_date date, illiquid boolean")
    rows = events.selectExpr("symbol", "earnings_date", "'insufficient_data' AS analysis_status")
    volume = spark.createDataFrame([("A", 42.5), ("B", 42.49999999999999)], "symbol string, dollar_volume double")
    got = {r["reason"] for r in ledger.liquidity_decisions(events, rows, volume, 50).collect()}
    assert got == {"mean dollar volume 42 is under 50"}


def test_reaction_features_sort_no_bars(spark):
    plan = nodes(queries._features(spark, SF))
    assert "Window" not in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_unfolded_bars_and_rows_have_the_same_features(spark):
    e = fx.events(spark, SF)
    a, b = reaction.reaction_features(e, fx.unfolded(e)), reaction.reaction_features(e, fx.bars(e))
    assert a.count() == e.count() and queries.rounded(a).exceptAll(queries.rounded(b)).count() == 0


def test_today_snapshot_shuffles_no_bars(spark):
    """A union of retrievals would lose that bars are dealt as their events are, so every bar would be shuffled."""
    assert "Union" not in operations.today_snapshot(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_bars_of_coverage_are_neither_written_nor_shuffled(spark):
    """Unfolded beside their coverage rows: the plan has no join, shuffle or sort above the minutes, and no table of bars is read."""
    x = events.Inputs(spark, SF)
    plan = x.bars._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("posexplode")]
    assert not [n for n in ("Join", "Exchange", "Sort", "Window", "derived") if n in above]


def test_unfolded_bars_of_coverage_are_those_of_the_join(spark):
    x = events.Inputs(spark, SF)
    whole = ev.phase_bars(x.coverage, evx.retrieved(x.events, x.coverage))
    own = x.bars.select(*whole.columns)
    assert own.count() == whole.count() and own.exceptAll(whole).count() == 0


def test_unfolded_bars_outside_of_their_phase_are_refused(spark):
    rows = spark.createDataFrame([("p", 0), ("p", 1), ("p", 1), ("q", 9)], "phase string, minute int")
    assert rows.agg(reaction.repeats_in("p", 0, 2)).first()[0] == 1
    with pytest.raises(Exception, match="outside of the minutes"):
        rows.agg(reaction.repeats_in("p", 0, 1)).collect()


def test_authoritative_bars_are_not_shuffled(spark):
    """No exchange lies above the retrievals' bars."""
    plan = queries.authoritative_bars(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")]


def test_unfolding_some_minutes_gives_those_of_all(spark):
    """Passes that look for the reference and the signal unfold only the minutes that can matter; an event whose minute is null has none."""
    x = events.Inputs(spark, SF)
    values = x.events.select(*reaction.KEY, F.expr("CASE WHEN k % 3 > 0 THEN k % 100 END").cast("int").alias("at"))
    between = (F.col("at"), F.col("at") + 2)
    e = fx.unfolded(x.events)
    own, whole = e(values, between), e(values).filter(F.col("minute").between(*between))
    assert own.count() == whole.count() > 0 and own.exceptAll(whole).count() == 0
    b = x.unfolded(*ev.STUDY_PHASES)
    cols = [*reaction.KEY, "phase", "minute", "ts", "close", "id"]
    own, whole = ev.minutes_of(b(values, between)).select(*cols), ev.minutes_of(b(values)).filter(F.col("minute").between(*between)).select(*cols)
    assert own.count() == whole.count() > 0 and own.exceptAll(whole).count() == 0


def test_texts_of_bars_are_made_before_they_are_collected(spark):
    """collect_list works its argument out without generated code, so it gets a column as it is."""
    x = events.Inputs(spark, SF)
    plan = ev.evidence_digests(x.events.selectExpr("symbol", "earnings_date", *[f"'' AS {p}_response_sha256" for p in ("regular", "post")], *[f"earnings_date AS {p}_expected_{e}" for p in ("regular", "post") for e in ("start", "end")]), x.unfolded(*ev.STUDY_PHASES))
    assert "collect_list(rows" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_prices_in_millionths_round_halves_away_from_zero(spark):
    odd = [0.0000005, -0.0000005, 0.0000004999, 1.0000015, 100.1, -3.25, 8.9e12, 9.1e12, float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in odd], "x double")
    before = "CASE WHEN x IS NULL OR isnan(x) OR abs(x) > 9e12 THEN coalesce(CAST(x AS STRING), '-') ELSE CAST(CAST(round(CASE WHEN isnan(x) OR abs(x) > 9e12 THEN 0 ELSE x END * 1000000) AS BIGINT) AS STRING) END"
    got = rows.select(ev.micro(F.col("x")).alias("a"), F.expr(before).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


@pytest.mark.parametrize("name", ["phase_bars", "event_paths", "following_path", "event_detail"])
def test_bars_of_paths_are_not_sorted(spark, name):
    """The first bar of a time, an event's horizons and its first and last bar are found without a window over bars, and bars are not sorted for a join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = (events.QUERIES | operations.QUERIES)[name](spark, SF)._jdf.queryExecution().executedPlan()
        text = plan.toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "row_number" not in text
    depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
    lines = text.split("\n")
    for i, line in enumerate(lines):  # below a sort, up to the next line that lies no deeper, no minute is unfolded
        if line.lstrip(" :|+-").startswith("Sort ["):
            below = []
            for other in lines[i + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            unfolds = next((n for n, x in enumerate(below) if "explode(_minutes" in x or "posexplode(_minutes" in x), None)
            summed = next((n for n, x in enumerate(below) if "Aggregate(" in x), None)
            assert unfolds is None or (summed is not None and summed < unfolds), "\n".join([line, *below])


def test_first_bars_are_those_of_a_window(spark):
    x = events.inputs(spark, SF)
    cols = ["symbol", "earnings_date", "phase", "ts", "id", "close", "volume"]
    ours, theirs = x.first()(None).select(cols), ev.first_of_each(x.bars).select(cols)
    assert x.bars.count() > theirs.count() and ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()


def test_digests_of_outcomes_are_made_only_for_those_who_read_them(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("no digest is read")

    monkeypatch.setattr(events, "_KEPT", {})
    monkeypatch.setattr(events.oc, "with_outcome_digest", refused)
    for name in ("outcomes", "outcome_choice", "study_members", "study_result", "exclusion_counter"):
        events.QUERIES[name](spark, SF)


def methods(df) -> list[int]:
    """Sizes of the largest generated method of each stage, in bytes."""
    debug = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(df._jdf.queryExecution().executedPlan()))]


@pytest.mark.parametrize("phases", [ev.STUDY_PHASES, oc.PHASES, ev.PHASES])
def test_unfolding_bars_of_coverage_is_compiled(spark, phases):
    """The JVM interprets methods over 8,000 bytes, which took half of the time of unfolded bars."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        x = events.Inputs(spark, SF)
        sizes = methods(x.unfolded(*phases)(None)) + methods(ev.with_bar_texts(x.events, x.unfolded(*phases), phases, "rows"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000
