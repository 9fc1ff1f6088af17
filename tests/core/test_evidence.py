"""Gates, outcomes, studies, as-of joins, ledgers and streams on small hand-made tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators import asof, integrity, ledger, ranks, selection, study
from tidemark.operators import evidence as ev
from tidemark.operators import outcome as oc
from tidemark.sources import calendar as cal
from tidemark.streaming import live

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 3, 4)
at = lambda m, day=DAY: dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=m)
COVER = (
    "symbol string, earnings_date date, phase string, market_date date, session string, expected_start timestamp_ntz, expected_end timestamp_ntz, observed_minutes int, expected_minutes int, source string, "
    "received_at timestamp_ntz, response_sha256 string, collection_mode string, data_quality_flags array<string>"
)
BARS = "symbol string, session string, evidence_date date, received_at timestamp_ntz, source string, endpoint string, ts timestamp_ntz, open double, high double, low double, close double, volume long, id int, stale boolean"


def cover(symbol, phase, a, z, day=DAY, got=1260, flags=(), minutes=None, earnings=DAY):
    n = (z or 960) - (a or 570)
    return (symbol, earnings, phase, day, "regular" if phase.endswith("regular") else "extended", a if a is None else at(a, day), z if z is None else at(z, day), n if minutes is None else minutes, n, "feed", at(got, day), "a" * 64, "scheduled_capture", list(flags))


def bar(symbol, session, m, close, day=DAY, got=1260, volume=10, stale=False, endpoint="/v1/session-history", source="feed", high=None):
    return (symbol, session, day, at(got, day), source, endpoint, at(m, day), close, high or close + 0.1, close - 0.1, close, volume, 0, stale)


def path(symbol, close=lambda m: 103.0, skip=(), **how):
    return [bar(symbol, "regular", 959, 100.0)] + [bar(symbol, "extended", 960 + m, close(m), **how) for m in range(105) if m not in skip]


CASES = {  # symbol: coverage rows, bars, reason
    "A": ([("earnings_regular", 570, 960), ("earnings_postmarket", 960, 1200)], {}, None),
    "B": ([("earnings_regular", 570, 960)], {}, "phase_not_covered"),
    "C": ([("earnings_regular", 570, None), ("earnings_postmarket", 960, 1200)], {}, "bounds_missing"),
    "D": ([("earnings_regular", 570, 959), ("earnings_postmarket", 960, 1200)], {}, "bounds_invalid"),
    "E": ([("earnings_regular", 570, 780), ("earnings_postmarket", 780, 1200)], {}, "early_close"),
    "F": ([("earnings_regular", 570, 960), ("earnings_postmarket", 960, 1064)], {}, "coverage_ends_early"),
    "G": ([("earnings_regular", 570, 960), ("earnings_postmarket", 960, 1200)], {"skip": range(4, 105)}, "too_few_bars"),
    "H": ([("earnings_regular", 570, 960), ("earnings_postmarket", 960, 1200)], {"volume": 0}, "vwap_missing"),
    "I": ([("earnings_regular", 570, 960), ("earnings_postmarket", 960, 1200)], {"skip": range(93, 105)}, "no checkpoint bar within 10m for: 105m"),
    "J": ([("earnings_regular", 570, 960), ("earnings_postmarket", 960, 1200)], {"close": lambda m: 103.0 if m == 104 else 100.0}, "trigger_on_last_bar"),
    "K": ([("earnings_regular", 570, 960), ("earnings_postmarket", 960, 1200)], {"high": 1.0}, "invalid_postmarket_bar"),
}


def test_every_gate(spark):
    covers = [cover(s, p, a, z) for s, (rows, _, _) in CASES.items() for p, a, z in rows]
    bars = [b for s, (_, how, _) in CASES.items() for b in path(s, **how)]
    extra = {"L": "stale_retrieval", "M": None, "N": "fatal_flags: duplicate_minute_bars", "O": "duplicate_timestamp", "P": "reference_close_missing", "Q": "no_regular_bars", "R": "invalid_regular_bar"}
    for s in extra:
        covers += [cover(s, "earnings_regular", 570, 960), cover(s, "earnings_postmarket", 960, 1200, got=1100 if s == "L" else 1260, flags=["duplicate_minute_bars", "late"] if s == "N" else [])]
    bars += path("L", got=1100, stale=True)[1:] + path("L")[:1] + path("M", stale=True) + path("N") + path("O") + path("O")[5:6] + path("P")[1:] + [bar("P", "regular", 958, 100.0)] + path("Q")[1:] + path("R")[1:] + [bar("R", "regular", 959, 100.0, volume=-1)]
    events = spark.createDataFrame([(s, DAY, "amc") for s in [*CASES, *extra, "Z"]] + [("Y", DAY, "bmo")], "symbol string, earnings_date date, hour string")
    c, b = spark.createDataFrame(covers, COVER), spark.createDataFrame(bars + [bar("A", "extended", 961, 500.0, source="other"), bar("A", "extended", 962, 500.0, endpoint="/v1/history"), bar("A", "extended", 963, 500.0, got=1261)], BARS)
    header = ev.evidence_header(events, c)
    own = ev.phase_bars(c, b)
    f = {r["symbol"]: r for r in ev.evidence_features(header, own).collect()}
    assert {s: r["reason"] for s, r in f.items()} == {s: x[2] for s, x in CASES.items()} | extra | {"Z": "phase_not_covered"}
    assert (f["A"]["reaction_class"], f["A"]["delay_minutes"], f["A"]["source_bar_count"], round(f["A"]["high_return"], 6)) == ("immediate_continuation", 1, 106, 3.1)
    assert f["I"]["data_quality_flags"] == [] and f["H"]["data_quality_flags"] == ["volume_unavailable_for_vwap"] and f["N"]["data_quality_flags"] == ["duplicate_minute_bars", "late"]
    rows = ev.feature_rows(ev.evidence_features(ev.evidence_digests(header, own), own))
    assert ev.feature_violations(rows).count() == 0
    stored = {r["symbol"]: r for r in rows.collect()}
    assert stored["A"]["analysis_status"] == "complete" and stored["A"]["missing_fields"] == [] and stored["A"]["reaction_timestamp"] == at(961)
    assert stored["F"]["feature_window_start"] is None and len(stored["B"]["missing_fields"]) == 20 and stored["H"]["missing_fields"] == ["initial_return", "max_favorable_excursion", "max_adverse_excursion", "max_retracement", "reaction_vwap_proxy"]
    bad = rows.filter("symbol = 'A'").withColumn("return_5m", F.lit(None).cast("double"))
    assert [r["rule"] for r in ev.feature_violations(bad).collect()] == ["complete_row_incomplete"]
    again = ev.evidence_digests(header, own.repartition(5, "ts"))
    assert {tuple(r) for r in again.select("symbol", "source_evidence_sha256").collect()} == {(s, r["source_evidence_sha256"]) for s, r in stored.items()}


def test_carried_checkpoints_are_flagged(spark):
    c = spark.createDataFrame([cover("A", "earnings_regular", 570, 960), cover("A", "earnings_postmarket", 960, 1200)], COVER)
    b = spark.createDataFrame(path("A", skip=[4, *range(100, 105)]), BARS)
    e = spark.createDataFrame([("A", DAY, "amc")], "symbol string, earnings_date date, hour string")
    r = ev.evidence_features(ev.evidence_header(e, c), ev.phase_bars(c, b)).first()
    assert r["reason"] is None and r["data_quality_flags"] == ["checkpoint_5m_carried_forward_1m", "checkpoint_105m_carried_forward_5m"]


def outcome(spark, earnings, following, shut, now, minutes=None, cut=(), covered=True):
    """An event whose next session is `following`; minutes: what its coverage says it saw; cut: minutes without a bar."""
    covers = [cover("A", "earnings_regular", 570, 960, earnings, earnings=earnings), cover("A", "following_premarket", 420, 570, following, earnings=earnings)]
    covers += [cover("A", "following_regular", 570, shut, following, minutes=minutes, earnings=earnings)] if covered else []
    bars = [bar("A", "regular", 959, 100.0, earnings), bar("A", "extended", 430, 101.0, following), bar("A", "extended", 500, 102.0, following)]
    bars += [bar("A", "regular", m, 103.0, following) for m in range(570, shut) if m - 570 not in cut]
    e = spark.createDataFrame([("A", earnings, "amc")], "symbol string, earnings_date date, hour string")
    c, b = spark.createDataFrame(covers, COVER), spark.createDataFrame(bars, BARS)
    return oc.session_outcomes(e, c, ev.phase_bars(c, b), cal.calendar(spark, 2023, 2025), now=now).first()


def test_outcomes_follow_the_calendar(spark):
    eve, fifth = dt.date(2024, 7, 3), dt.date(2024, 7, 5)  # the session after 3 July is 5 July
    r = outcome(spark, eve, fifth, 960, "2024-07-04 17:00:00", covered=False)
    assert (r["analysis_status"], r["available_after"]) == ("not_yet_available", at(970, fifth))
    r = outcome(spark, eve, fifth, 960, "2024-07-05 16:11:00")
    assert (r["analysis_status"], r["missing_fields"], r["premarket_first"], r["premarket_last"], r["premarket_last_ts"], r["regular_return_5m"]) == ("complete", [], 101.0, 102.0, at(500, fifth), 3.0)
    black, friday = dt.date(2024, 11, 27), dt.date(2024, 11, 29)  # a session that ends at 13:00
    r = outcome(spark, black, friday, 780, "2024-11-29 13:05:00")
    assert (r["analysis_status"], r["available_after"], r["following_regular_expected_minutes"]) == ("complete", at(790, friday), 210)
    for now, minutes, want in (("2024-11-29 13:05:00", 200, "not_yet_available"), ("2024-11-29 12:59:00", None, "not_yet_available"), ("2024-11-29 13:10:00", 190, "insufficient_data"), ("2024-11-29 13:10:00", 200, "complete")):
        assert outcome(spark, black, friday, 780, now, minutes=minutes)["analysis_status"] == want
    r = outcome(spark, black, friday, 780, "2024-12-02 10:00:00", cut=[4, 209])
    assert r["analysis_status"] == "insufficient_data" and r["missing_fields"] == ["regular_close", "regular_return_5m"]
    r = outcome(spark, black, friday, 780, "2024-12-02 10:00:00", covered=False)
    assert "following_regular" in r["missing_fields"] and r["following_regular_coverage_ratio"] == 0.0 and r["following_regular_expected_minutes"] == 390


MEMBER = "study_key string, version int, stage string, symbol string, earnings_date date, delay_minutes int, metric double, reasons array<string>, included boolean, eligible boolean, outcome_status string, least_sample int, expected_direction string"


def test_gates_and_the_frozen_rule(spark):
    def m(study, stage, n, delay, metric, lost=0, way="higher"):
        return [(study, 1, stage, f"{stage}{k}", DAY, delay(k), metric(k) if k >= lost else None, [] if k >= lost else ["outcome_not_complete"], k >= lost, True, "complete" if k >= lost else "insufficient_data", 5, way) for k in range(n)]

    early = lambda k: 2.0 if k % 2 else -1.0
    data = [x for s in "ab" for x in m(s, "development", 6, lambda k: k + 1, early)] + m("a", "oos", 12, lambda k: 1 if k % 2 else 50, early) + m("b", "oos", 12, lambda k: 1 if k % 2 else 50, early, lost=5)
    data += m("c", "development", 4, lambda k: 7, early) + m("c", "oos", 12, lambda k: 1, early, way="lower") + m("d", "oos", 3, lambda k: 1, early)
    r = {(x["study_key"], x["stage"]): x for x in study.results(spark.createDataFrame(data, MEMBER)).collect()}
    assert r["a", "development"]["threshold"] == r["a", "oos"]["threshold"] == 3.5 and r["a", "development"]["decision"] == "refine"
    assert (r["a", "oos"]["n_early"], r["a", "oos"]["n_late"], r["a", "oos"]["difference"], r["a", "oos"]["decision"]) == (6, 6, 3.0, "paper_trade_candidate")
    b = r["b", "oos"]  # five eligible events without an outcome: rejected, though the direction fits
    assert (b["eligible"], b["n"], b["sample_gate"], b["coverage_gate"], b["decision"]) == (12, 7, True, False, "reject")
    assert not r["c", "oos"]["sample_gate"] and r["c", "oos"]["decision"] == "reject" and r["d", "oos"]["threshold"] is None and r["d", "oos"]["decision"] == "reject"
    frozen = spark.createDataFrame([("a", 1, 0.5)], "study_key string, version int, threshold double")
    assert [(x["stage"], x["n_early"]) for x in study.results(spark.createDataFrame(data, MEMBER), frozen).orderBy("stage").collect()] == [("development", 0), ("oos", 0)]


def test_members_need_a_finished_feature(spark):
    f = spark.createDataFrame([("A", "insufficient_data", None, None), ("B", "complete", "whipsaw", 3), ("C", "complete", "whipsaw", 3), ("D", "complete", "whipsaw", 3)], "symbol string, analysis_status string, reaction_class string, detection_delay_minutes int")
    f = f.withColumns({"earnings_date": F.lit(DAY), **{n: F.lit(v) for n, v in zip(ev.VERSION_COLUMNS, ev.VERSIONS, strict=True)}, "source_evidence_sha256": F.lit("x"), "data_quality_flags": F.array().cast("array<string>")})
    f = f.withColumns({n: F.lit(None).cast("double") for n in ("initial_return", "return_105m", "volume_105m", "study_coverage_ratio")}).withColumns({n: F.lit(None).cast("string") for n in ("reaction_direction", "earnings_postmarket_collection_mode")})
    o = spark.createDataFrame([("A", "complete", 1.0), ("B", "complete", 1.0), ("C", "insufficient_data", 1.0)], "symbol string, analysis_status string, regular_close_return double")
    o = o.withColumns({"earnings_date": F.lit(DAY), "outcome_version": F.lit(oc.OUTCOME_VERSION), "source_evidence_sha256": F.lit("y"), "data_quality_flags": F.array().cast("array<string>")})
    scope = f.select("symbol", "earnings_date", F.lit(0.0).alias("eps_surprise_pct"))
    plan = spark.createDataFrame([("s", 1, DAY, DAY, dt.date(2025, 1, 1), dt.date(2025, 2, 1), 1, 1, "higher")], "study_key string, version int, development_from date, development_to date, oos_from date, oos_to date, least_development int, least_oos int, expected_direction string")
    got = {r["symbol"]: (r["reasons"], r["included"], r["eligible"]) for r in study.members(plan, scope, f, o).collect()}
    assert got == {"A": (["feature_not_complete"], False, False), "B": ([], True, True), "C": (["outcome_not_complete"], False, True), "D": (["outcome_missing"], False, True)}


def test_split_by_days(spark):
    e = spark.createDataFrame([("A", dt.date(2024, 1, 1)), ("A", dt.date(2024, 4, 10))], "symbol string, earnings_date date")  # 100 days
    assert tuple(selection.development_split(e, 0.3).first()) == (dt.date(2024, 1, 1), dt.date(2024, 3, 10), dt.date(2024, 3, 11), dt.date(2024, 4, 10))
    with pytest.raises(ValueError):
        selection.development_split(e, 1.0)


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("a", None), ("b", 9), (None, 4), ("a", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("a", 7, 70), ("c", 1, 1), (None, 3, 30), ("a", None, 99)], "k string, at int, v int")
    got = sorted(map(tuple, asof.asof_join(left, right, ["k"], "t", "at", tie=["v"]).collect()), key=str)
    assert got == sorted([("a", 5, 5, 51), ("a", 5, 5, 51), ("a", 1, None, None), ("a", None, None, None), ("b", 9, None, None), (None, 4, 3, 30)], key=str)
    near = asof.asof_join(left, right, ["k"], "t", "at", tie=["v"], tolerance=F.col("t") - F.col("at") < 1)
    assert sorted(r["v"] for r in near.collect() if r["v"]) == [51, 51]


@pytest.mark.parametrize("piece_rows", [10, 1_000_000])
def test_quantiles_are_exact(spark, piece_rows):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=301), "b": rng.integers(0, 4, 100).astype(float), "c": np.array([2.0]), None: np.exp(rng.normal(size=77) * 9), "d": np.array([])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("d", None)], "k string, v double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r["k"]: (r["n"], r["q"]) for r in ranks.quantiles(df, ["k"], "v", probs, piece_rows).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, (n, q) in got.items():
        assert n == len(values[k]) and np.allclose(q, np.quantile(values[k], probs), rtol=1e-12)
    every = np.concatenate(list(values.values()))
    assert np.allclose(ranks.quantiles(df, [], "v", probs, piece_rows).first()["q"], np.quantile(every, probs), rtol=1e-12)
    assert ranks.quantiles(df.limit(0), [], "v", probs).count() == 0


def test_a_large_key_is_cut(spark):
    rng = np.random.default_rng(3)
    left = [("hot" if x < 0.5 else f"k{int(x * 20)}", int(t)) for x, t in zip(rng.random(600), rng.integers(0, 500, 600), strict=True)] + [("hot", None), (None, 100), ("hot", 10_000), ("hot", -1)]
    right = [("hot" if x < 0.6 else f"k{int(x * 20)}", int(t), i) for i, (x, t) in enumerate(zip(rng.random(300), rng.integers(100, 400, 300), strict=True))] + [("hot", None, 999), (None, 50, 998)]
    a, b = spark.createDataFrame(left, "k string, t int"), spark.createDataFrame(right, "k string, at int, v int")
    rows = lambda n: sorted(map(tuple, asof.asof_join(a, b, ["k"], "t", "at", tie=["v"], piece_rows=n).collect()), key=str)
    brute = []
    for k, t in left:
        m = max(((at, v) for kk, at, v in right if kk == k and at is not None and t is not None and at <= t), default=(None, None))
        brute.append((k, t, *m))
    assert rows(20) == rows(1_000_000) == sorted(brute, key=str)
    x = b.filter("at IS NOT NULL")
    pieces = ranks.in_pieces(x, ranks.cut_points(x, ["k"], "at", 20), ["k"], "at").groupBy("k", "__piece").count().collect()
    assert max(r["count"] for r in pieces) <= 60 and len([r for r in pieces if r["k"] == "hot"]) >= 5


def test_changed_rows_open_what_differs(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "b", 1), (3, "c", 2), (4, None, None), (5, "e", 3)], "id int, v string, part int")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (9, "n", 1), (3, "C", 2), (4, None, None), (5, "e", 3), (6, "f", 4)], old.schema)
    want = sorted(map(tuple, integrity.changed_rows(old, new).collect()), key=str)
    assert want == [(1, "a", 1), (3, "c", 2)] and sorted(map(tuple, integrity.changed_rows(old, new, ["part"]).collect()), key=str) == want
    assert integrity.changed_rows(old, old.unionByName(new), ["part"]).count() == 0
    assert integrity.changed_rows(old, new.filter("part <> 3 OR part IS NULL"), ["part"]).filter("id = 5").count() == 1


def test_ledger_null_keys_conflicts_and_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(None, DAY, "a"), (1, DAY, "b"), (1, DAY, "b"), (1, None, "c")], "k int, day date, v string")
    for path, by in ((f"{tmp_path}/plain", None), (f"{tmp_path}/parts", "day")):
        assert ledger.append_counted(rows, path, ["k", "day"], by) == (3, 1)
        assert ledger.append_counted(rows, path, ["k", "day"], by) == (0, 4)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception) as e:
        ledger.append_counted(rows, f"{tmp_path}/broken", ["k"])
    assert not (isinstance(e.value, AnalysisException) and e.value.getCondition() == "PATH_NOT_FOUND")


def test_idle_cycles_are_told_once_and_failures_are_kept(spark, tmp_path):
    day = dt.datetime(2024, 3, 4)
    tick = lambda k, h: (k, f"S{k}", day + dt.timedelta(hours=h), "view")
    schema, src = "event_id long, symbol string, event_timestamp timestamp_ntz, event_type string", f"{tmp_path}/in"
    for k, h in enumerate((3, 4, 16, 17, 22)):
        spark.createDataFrame([tick(k, h)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    c = f"{tmp_path}/cycles"
    live.stream_cycles(stream, f"{tmp_path}/q", c, f"{tmp_path}/k", ["event_id"], cal.calendar(spark, 2024, 2024)).awaitTermination()
    assert [r["status"] for r in spark.read.parquet(c).orderBy("batch").collect()] == ["inactive", "success", "success", "inactive"]
    assert spark.read.parquet(f"{tmp_path}/q").count() == 2
    listener = live.CycleListener(spark, c)
    event = type("E", (), {"id": "x", "exception": "ValueError: no feed\nat x", "errorClassOnException": None})()
    listener.onQueryTerminated(event)
    assert [r["error_message"] for r in spark.read.parquet(c).filter("status = 'degraded'").collect()] == ["ValueError: no feed"]


def test_the_outcome_digest_sees_every_bar_time_and_flag(spark):
    earnings, following = dt.date(2024, 3, 4), dt.date(2024, 3, 5)
    covers = [cover("A", "earnings_regular", 570, 960, earnings, earnings=earnings), cover("A", "following_premarket", 420, 570, following, earnings=earnings), cover("A", "following_regular", 570, 960, following, earnings=earnings)]
    bars = [bar("A", "regular", 700, 99.0, earnings), bar("A", "regular", 959, 100.0, earnings), bar("A", "extended", 430, 101.0, following), bar("A", "regular", 599, 103.0, following), bar("A", "regular", 777, 104.0, following)]
    e = spark.createDataFrame([("A", earnings, "amc")], "symbol string, earnings_date date, hour string")
    days = cal.calendar(spark, 2024, 2024)

    def digest(covers, bars):
        c = spark.createDataFrame(covers, COVER)
        b = ev.phase_bars(c, spark.createDataFrame(bars, BARS))
        return oc.with_outcome_digest(oc.session_outcomes(e, c, b, days, now="2024-03-06 10:00:00"), c, b).first()["source_evidence_sha256"]

    base = digest(covers, bars)
    assert base == digest(covers[::-1], bars[::-1])
    names = [f.split(" ")[0] for f in BARS.split(", ")]
    seen = {base}
    for k in range(len(bars)):  # any bar of any phase: its close, its volume, its time, and its loss
        for field, change in (("close", lambda v: v + 0.01), ("volume", lambda v: (v or 0) + 1), ("ts", lambda v: v + dt.timedelta(minutes=1) if v.minute % 10 != 9 else v - dt.timedelta(minutes=1))):
            row = list(bars[k])
            row[names.index(field)] = change(row[names.index(field)])
            seen.add(digest(covers, bars[:k] + [tuple(row)] + bars[k + 1 :]))
        seen.add(digest(covers, bars[:k] + bars[k + 1 :]))
    fields = [f.split(" ")[0] for f in COVER.split(", ")]
    for k in range(3):
        row = list(covers[k])
        row[fields.index("data_quality_flags")] = ["late_start"]
        seen.add(digest(covers[:k] + [tuple(row)] + covers[k + 1 :], bars))
    assert len(seen) == 1 + 4 * len(bars) + 3


def test_outcome_rows_and_long_runs(spark):
    o = spark.createDataFrame([("A", dt.date(2024, 3, 4), "complete", "1"), ("B", dt.date(2024, 3, 5), "not_yet_available", "2"), ("C", dt.date(2025, 3, 9), "complete", "3")], "symbol string, earnings_date date, analysis_status string, source_evidence_sha256 string")
    assert [r["symbol"] for r in oc.outcomes_to_store(o, "2024-03-04", "2025-03-09").collect()] == ["A", "C"]
    assert '"least_regular_coverage":0.95' in oc.outcomes_to_store(o).first()["parameters"]
    for bad in (("2024-03-04", "2025-03-10"), ("2024-03-04", "2024-03-03")):
        with pytest.raises(ValueError):
            oc.outcomes_to_store(o, *bad)


def test_each_limit_of_a_plan_decides_and_nulls_never_pass(spark):
    limits = {
        "statuses": ["complete"], "classes": ["whipsaw"], "directions": ["up"], "modes": ["scheduled_capture"], "least_abs_return": 2.0, "most_abs_return": 4.0, "least_retention": 0.5, "most_retention": 1.5, "least_delay": 5.0, "most_delay": 20.0,
        "least_volume": 100.0, "least_coverage": 0.9, "least_surprise": 0.0, "most_surprise": 10.0,
    }
    good = {"analysis_status": "complete", "reaction_class": "whipsaw", "reaction_direction": "up", "earnings_postmarket_collection_mode": "scheduled_capture", "initial_return": 3.0, "return_105m": 3.0, "detection_delay_minutes": 10, "volume_105m": 200, "study_coverage_ratio": 1.0}
    spoilt = {
        "analysis_status": ["insufficient_data"], "reaction_class": ["spike_and_fade", None], "reaction_direction": ["down", None], "earnings_postmarket_collection_mode": ["historical_backfill", None], "initial_return": [-1.0, 5.0, None],
        "return_105m": [1.0, 9.0], "detection_delay_minutes": [4, 21, None], "volume_105m": [99, None], "study_coverage_ratio": [0.89, None],
    }
    rows = [good] + [good | {c: v} for c, vs in spoilt.items() for v in vs]
    kinds = {"initial_return": "double", "return_105m": "double", "detection_delay_minutes": "int", "volume_105m": "long", "study_coverage_ratio": "double"}
    cols = list(good)
    schema = "symbol string, earnings_date date, feature_version string, detector_version string, classifier_version string, source_evidence_sha256 string, data_quality_flags array<string>, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in cols)
    f = spark.createDataFrame([(f"S{i}", DAY, *ev.VERSIONS, "x", [], *[r[c] for c in cols]) for i, r in enumerate(rows)] + [("S0", DAY, "features-0", *ev.VERSIONS[1:], "y", [], *[good[c] for c in cols])], schema)
    scope = spark.createDataFrame([(f"S{i}", DAY, 5.0) for i in range(len(rows))] + [("E1", DAY, -1.0), ("E2", DAY, 11.0), ("E3", DAY, None)], "symbol string, earnings_date date, eps_surprise_pct double")
    more = spark.createDataFrame([(s, DAY, *ev.VERSIONS, "x", [], *[good[c] for c in cols]) for s in ("E1", "E2", "E3")], schema)
    o = spark.createDataFrame([(f"S{i}", DAY, "outcome-1", "complete", 1.0, str(k), []) for i in range(len(rows)) for k in range(2)] + [(s, DAY, "outcome-1", "complete", 1.0, "9", []) for s in ("E1", "E2", "E3")], "symbol string, earnings_date date, outcome_version string, analysis_status string, regular_close_return double, source_evidence_sha256 string, data_quality_flags array<string>")
    one = "study_key string, version int, development_from date, development_to date, oos_from date, oos_to date, least_development int, least_oos int, expected_direction string"
    base = ("s", 1, DAY, DAY, dt.date(2025, 1, 1), dt.date(2025, 2, 1), 1, 1, "higher")
    plan = lambda extra: spark.createDataFrame([base], one).withColumns({n: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v) for n, v in extra.items()})
    every = study.members(plan(limits), scope, f.unionByName(more), o).filter("stage = 'development'").collect()
    assert len(every) == len(rows) + 3 and [r["symbol"] for r in every if r["included"]] == ["S0"]
    codes = {x for r in every for x in r["reasons"] if x.endswith("_excluded")}
    assert codes == {f"{c}_excluded" for *_, c in (*study.LISTS, *study.BOUNDS)}
    free = study.members(plan({}), scope, f.unionByName(more), o).filter("stage = 'development'")
    assert not any(x.endswith("_excluded") for r in free.collect() for x in r["reasons"]) and free.filter("symbol = 'S0'").first()["outcome_sha"] == "0"
    old = study.members(plan({"feature_version": "features-0"}), scope, f, o).filter("stage = 'development'").collect()
    assert {r["symbol"]: r["feature_sha"] for r in old if r["feature_sha"]} == {"S0": "y"}
    few = study.members(plan({"symbols": ["S1", "S2"], "outcome_version": "outcome-9"}), scope, f, o).filter("stage = 'development'").collect()
    assert sorted(r["symbol"] for r in few) == ["S1", "S2"] and all("outcome_missing" in r["reasons"] for r in few)


def test_only_finite_rows_have_a_text(spark):
    from tidemark.functions.columns import canonical_text, only_finite

    ok = spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double")
    assert [r[0] for r in ok.select(only_finite(ok, canonical_text("b", "a"))).collect()] == ['{"a":1,"b":2.5}', '{"a":2,"b":null}']
    for x in (float("nan"), float("-inf")):
        bad = spark.createDataFrame([(1, x)], ok.schema)
        with pytest.raises(Exception, match="not finite"):
            bad.select(only_finite(bad, canonical_text("a", "b"))).collect()
