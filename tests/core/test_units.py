"""Expected values of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import bar_problem, norm_symbol, pct_change, row_digest, stale_is_fatal, surprise_pct
from tidemark.operators import ledger, reaction, research
from tidemark.operators.bars import minute_bars
from tidemark.sources import fixtures as fx
from tidemark.streaming.bars import stream_minute_bars, stream_quotes

DAY = dt.date(2024, 3, 4)


def features(spark, path, volume=10, drop=(), edit=None):
    """Features of one event whose window close is path(minute); the reference close is 100."""
    rows = [("A", DAY, "earnings_regular", -1, 100.0, 100.1, 99.9, 100.0, 100)]
    for m in range(105):
        if m not in drop:
            c = float(path(m))
            r = ["A", DAY, "earnings_postmarket", m, c, c + 0.1, c - 0.1, c, volume]
            rows.append(tuple(edit(m, r) if edit else r))
    bars = spark.createDataFrame(rows, "symbol string, earnings_date date, phase string, minute int, open double, high double, low double, close double, volume long")
    head = spark.createDataFrame([("A", DAY, True, False, False)], "symbol string, earnings_date date, post_covered boolean, stale boolean, early_close boolean")
    return reaction.reaction_features(head, bars).first()


def test_horizons(spark):
    r = features(spark, lambda m: 103 + m / 100)
    assert [round(r[f"return_{h}m"], 2) for h in (1, 5, 105)] == [3.0, 3.04, 4.04] and (r["volume_1m"], r["volume_105m"]) == (10, 1050)
    assert (r["reaction_class"], r["direction"], r["delay_minutes"]) == ("immediate_continuation", "up", 1)


def test_no_trigger_and_intrabar_spike(spark):
    r = features(spark, lambda m: 100.5)
    assert r["reaction_class"] == "no_trigger_in_window" and round(r["high_return"], 6) == 0.6 and round(r["low_return"], 6) == 0.4
    assert features(spark, lambda m: 100.5, edit=lambda m, r: r[:5] + [103.0] + r[6:] if m == 5 else r)["reaction_class"] == "no_trigger_in_window"


@pytest.mark.parametrize("first,kind,delay", [(13, "immediate_continuation", 14), (14, "delayed_breakout", 15)])
def test_delay_boundary(spark, first, kind, delay):
    r = features(spark, lambda m: 103 if m >= first else 100)
    assert (r["reaction_class"], r["delay_minutes"]) == (kind, delay)


def test_precedence_and_gates(spark):
    assert features(spark, lambda m: 100 if m < 20 else 103 if m < 40 else 100.5)["reaction_class"] == "spike_and_fade"
    assert features(spark, lambda m: 103 if m < 5 else 97)["reaction_class"] == "whipsaw"
    assert features(spark, lambda m: 103, drop=range(95, 105))["reaction_class"] == "immediate_continuation"
    assert features(spark, lambda m: 103, drop=range(93, 105))["reason"] == "no checkpoint bar within 10m for: 105m"
    assert features(spark, lambda m: 103, drop=[0])["reason"] == "no checkpoint bar within 10m for: 1m"
    assert features(spark, lambda m: 103, volume=0)["reason"] == "vwap_missing"
    assert features(spark, lambda m: 103, volume=-1)["reason"] == "invalid_bar"
    assert features(spark, lambda m: 103 if m == 104 else 100)["reason"] == "trigger_on_last_bar"


def test_trigger_candle_is_left_out(spark):
    r = features(spark, lambda m: 103, edit=lambda m, r: r[:5] + [110.0] + r[6:] if m == 0 else r)
    assert round(r["high_return"], 6) == 10.0 and round(r["mfe"], 6) == 3.1


def test_column_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    d = lambda v: F.lit(v).cast("double")
    assert get(pct_change(d(0), d(1))) is None and get(pct_change(d(None), d(1))) is None and get(pct_change(d(50), d(55))) == 10.0
    assert get(surprise_pct(d(1), d(-2))) == 150.0
    assert get(bar_problem(d(1), d(float("nan")), d(1), d(1), F.lit(1))) == "non_finite_price" and get(bar_problem(d(1), d(2), d(1), d(1), F.lit(1))) is None
    assert get(stale_is_fatal(F.lit(True), F.lit(None).cast("int"), F.lit(1))) and not get(stale_is_fatal(F.lit(True), F.lit(2), F.lit(1)))
    assert get(norm_symbol(F.lit(" brk.b "))) == "BRK.B" and get(norm_symbol(F.lit("1x"))) is None
    r = spark.createDataFrame([(1, None)], "a int, b string")
    assert r.select(row_digest("t", "a", "b").alias("x")).first() == r.select(row_digest("t", "b", "a").alias("x")).first()


def test_ledger_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    path = f"{tmp_path}/ledger"
    assert (ledger.append_ledger(rows, path, ["k"]), ledger.append_ledger(rows, path, ["k"])) == (2, 0)
    assert spark.read.parquet(path).count() == 2


def test_streamed_bars_equal_batch(spark, tmp_path):
    t = fx.ticks(spark, "/root/testdata/sf0.001")
    t = t.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    src = f"{tmp_path}/in"
    t.coalesce(1).write.parquet(src)
    read = spark.readStream.schema(t.schema).parquet(src)
    stream_minute_bars(read, f"{tmp_path}/out", f"{tmp_path}/c", "1 minute", "1 hour").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in minute_bars(t, "1 hour").collect()}
    last = max(r[1] for r in want)
    assert got <= want and {r for r in want if r[1] < last} <= got
    for k in ("c1", "c2"):
        stream_quotes(read, f"{tmp_path}/quotes", f"{tmp_path}/{k}", ["event_id"]).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/quotes").count() == t.count()


def test_orders_put_nulls_where_they_belong(spark):
    u = spark.createDataFrame(
        [("A", DAY, -3.0, 1.0, 105), ("B", DAY, 2.0, None, 50), ("C", dt.date(2024, 3, 5), None, 2.0, None), ("D", DAY, 2.0, 0.5, 80)],
        "symbol string, earnings_date date, initial_return double, retention double, observed_minutes int",
    ).withColumns({c: F.lit(None).cast("double") for c in ("return_105m", "delay_minutes", "volume_105m", "eps_surprise")})
    page = lambda by, **k: "".join(r["symbol"] for r in research.cohort_page(u, research.Cohort(**k), 9, 0, by).collect())
    want = {"abs_initial_return_desc": "ABDC", "initial_return_asc": "ABDC", "initial_return_desc": "BDAC", "retention_desc": "CADB", "retention_asc": "DACB", "coverage_ratio_asc": "CBDA"}
    want |= {"symbol_asc": "ABCD", "earnings_date_desc": "CABD", "earnings_date_asc": "ABDC", "volume_105m_desc": "CABD"}
    assert {by: page(by) for by in want} == want
    assert all(len(page(by)) == 4 for by in research.ORDERS)
    assert page("symbol_asc", most_abs_return=2.5) == "BD" and page("symbol_asc", least_retention=1.0, least_coverage=0.9) == "A"


def test_issues_wait_for_the_deadline(spark):
    u = spark.createDataFrame([("A", DAY, False, None, None, False, 0)], "symbol string, earnings_date date, post_covered boolean, reaction_class string, reason string, backfilled boolean, observed_minutes int")
    kinds = lambda now: [r["kind"] for r in research.quality_issues(u, now).collect()]
    assert kinds("2024-03-04 20:09:59") == [] and kinds("2024-03-04 20:10:00") == ["missing_capture_phase"]
