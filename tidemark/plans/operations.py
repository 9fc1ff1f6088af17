"""Queries over landed responses, live state, the study registry and constraint checks, each with SQL for the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import moves, reaction, registry, selection
from ..operators.reaction import KEY
from ..sources import fixtures as fx
from ..sources import landed
from . import queries as core
from .queries import rounded

_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_PRICES = ["open", "high", "low", "close"]


def _hours(n: int):
    return F.col("earnings_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(n))


# --- inputs as responses: JSON texts built from the tables ---


def _calendar_texts(spark: SparkSession, d: str) -> DataFrame:
    """A response per symbol and year, some cut off."""
    entry = F.struct("symbol", F.col("earnings_date").alias("date"), "hour", F.col("eps_estimate").alias("epsEstimate"), F.col("eps_actual").alias("epsActual"), "quarter", "year")
    t = fx.events(spark, d).groupBy("symbol", "year").agg(F.to_json(F.struct(F.collect_list(entry).alias("earningsCalendar"))).alias("value"), F.min("k").alias("k"))
    return t.select("symbol", "year", F.when(F.col("k") % 43 == 0, F.substring("value", 1, 30)).otherwise(F.col("value")).alias("value"))


def _session_texts(spark: SparkSession, d: str) -> DataFrame:
    """A response per event's evening; some are cut off, of another day or of another session."""
    candle = F.struct(F.col("ts").alias("timestamp"), *_PRICES, "volume")
    g = fx.bars(fx.events(spark, d)).filter("phase = 'earnings_postmarket'").groupBy(*KEY, "k").agg(F.collect_list(candle).alias("candles"))
    body = F.struct(
        "symbol", _hours(21).alias("gateway_received_at"), F.lit("feed").alias("source"), F.lit(False).alias("stale"),
        F.when(F.col("k") % 53 == 0, "regular").otherwise("extended").alias("session"), F.expr("date_add(earnings_date, IF(k % 47 = 0, 1, 0))").alias("date"), "candles",
    )
    text = F.to_json(F.struct(F.lit("1").alias("schema_version"), body.alias("session_history")), _JSON)
    return g.select(
        F.when(F.col("k") % 43 == 0, F.substring(text, 1, 60)).otherwise(text).alias("value"), F.col("symbol").alias("asked_symbol"), F.col("earnings_date").alias("asked_date"),
        F.lit("extended").alias("asked_session"),
    )


def landed_calendar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(landed.calendar_entries(_calendar_texts(spark, d)))


def landed_rejects(spark: SparkSession, d: str) -> DataFrame:
    return landed.rejected(_calendar_texts(spark, d), landed.CALENDAR, "earningsCalendar").select("symbol", "year")


def landed_session_bars(spark: SparkSession, d: str) -> DataFrame:
    b = landed.session_bars(_session_texts(spark, d), "historical_backfill")
    return rounded(b.select("symbol", "ts", "session", "evidence_date", *_PRICES, "volume", "gateway_received_at", "gateway_endpoint", "frequency", "collection_mode"))


def retrieval_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return landed.misdirected(_session_texts(spark, d))


def history_collection(spark: SparkSession, d: str) -> DataFrame:
    """Minute histories, each landed twice, of the symbols with a liquid event."""
    e = fx.events(spark, d)
    candle = F.struct(F.col("ts").alias("timestamp"), *_PRICES, "volume")
    g = fx.bars(e).groupBy(*KEY, "k").agg(F.collect_list(candle).alias("bars"))
    body = F.struct("symbol", _hours(22).alias("gateway_received_at"), F.lit("feed").alias("source"), F.when(F.col("k") % 41 == 0, "daily").otherwise("minute").alias("frequency"), "bars")
    t = g.select(F.to_json(F.struct(F.lit("1").alias("schema_version"), body.alias("history")), _JSON).alias("value"))
    b = landed.collected_bars(t.unionAll(t), e.filter("NOT illiquid").select("symbol"))
    return rounded(b.select("symbol", "ts", "session", "evidence_date", "close", "volume", "gateway_received_at", "frequency"))


def landed_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = F.struct("symbol", "event_timestamp", F.col("received_at").alias("gateway_received_at"), "last", "bid", "ask", "volume", "stale")
    t = fx.ticks(spark, d).groupBy("symbol", "earnings_date").agg(F.to_json(F.struct(F.lit("1").alias("schema_version"), F.collect_list(q).alias("quotes")), _JSON).alias("value"))
    x = landed.quotes(t, "after_hours")
    return rounded(x.select("symbol", "earnings_date", "event_timestamp", "gateway_received_at", "last", "bid", "ask", "volume", "stale", "capture_window", "exchange_status"))


# --- moves, live state, selection ---


def realized_moves(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    windows = F.create_map(*[F.lit(x) for p in (("earnings_regular", "day_before"), ("earnings_postmarket", "after_hours"), ("following_regular", "day_after")) for x in p])
    cols = [*KEY, "phase", "minute", "open", "close"]
    c = fx.bars(e).select(*cols).unionByName(fx.following(e).filter("phase = 'following_regular'").select(*cols))
    flags = {"day_before_captured": F.col("k") % 43 != 0, "day_after_captured": F.col("k") % 47 != 0}
    return rounded(moves.realized_moves(e.withColumns(flags), c.withColumn("capture_window", windows[F.col("phase")]).withColumnRenamed("minute", "ts")))


def _event_quotes(bars: DataFrame) -> DataFrame:
    q = bars.filter("phase = 'earnings_postmarket' AND minute % 15 = 0 AND id = 0")
    return q.select(
        *KEY, F.col("minute").alias("received_at"), (F.col("close") - 0.05).alias("bid"), F.expr("CASE WHEN k % 31 <> 0 THEN close + 5e-2 END").alias("ask"), F.col("close").alias("last"),
        F.expr("k % 41 = 0").alias("stale"), F.expr("(k + minute) % 90").alias("age_seconds"),
        F.expr("CASE WHEN k % 4 = 1 THEN array('wide_spread', 'stale') WHEN k % 7 = 2 THEN array('stale', 'late') END").alias("quality_flags"),
    )


def today_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Every day's snapshot; features of 1998 on are not finished, and an earlier retrieval has other prices."""
    e = fx.events(spark, d)
    b = fx.bars(e)
    both = b.withColumn("received_at", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("close", F.expr("IF(received_at = 0, close * 3, close)"))  # no union: bars stay dealt as the events are
    done = reaction.reaction_features(e, fx.unfolded(e)).filter("year(earnings_date) < 1998")
    return rounded(moves.today_snapshot(e, done, _event_quotes(b), both, dealt=True))


def captured_pending(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    return selection.captured_and_pending(e, _event_quotes(fx.bars(e)))


def capture_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    return selection.capture_candidates(e, fx.bars(e).select(*KEY, "phase").distinct(), "earnings_postmarket")


def active_symbols(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    return selection.active_symbols(e, core._calendar(spark, d), e.select(F.col("earnings_date").alias("day")))


def clean_notes(spark: SparkSession, d: str) -> DataFrame:
    c = fx.read(spark, d, "conversations")
    raw = c.select(
        "conv_id", "turn", F.concat(F.lit(" "), "role").alias("author"), F.expr("CASE WHEN (conv_id + turn) % 7 = 0 THEN '  ' ELSE text END").alias("body"),
        F.array(F.concat(F.lit(" "), F.upper("role"), F.lit(" ")), F.lit(""), "role", F.concat(F.lit("Turn"), (F.col("turn") % 3).cast("string"))).alias("tags"),
    )
    return selection.clean_notes(raw).withColumn("tags", F.array_join("tags", ";"))


def path_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.path_tail(fx.bars(fx.events(spark, d))).select(*KEY, "minute", "close", "part"))


def development_split(spark: SparkSession, d: str) -> DataFrame:
    return selection.development_split(fx.events(spark, d), 0.3)


def operations_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Newest and counted rows of each table: one row a table, put side by side."""
    q = fx.ticks(spark, d).agg(F.count("*").alias("quotes"), F.max("received_at").alias("newest_quote"), F.count_if("stale").alias("stale_quotes"))
    e = fx.events(spark, d).agg(F.count("*").alias("events"), F.max("earnings_date").alias("newest_event"), F.count_if("illiquid").alias("illiquid"), F.count_if("superseded").alias("superseded"))
    b = fx.daily_bars(spark, d).agg(F.count("*").alias("daily_bars"), F.max("session_date").alias("newest_session"))
    return q.crossJoin(e).crossJoin(b)  # one row each


# --- studies, reprocessing, constraints ---


def _specs(spark: SparkSession, d: str) -> DataFrame:
    p = fx.read(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    key = F.concat(F.lit("P"), F.col("k").cast("string"))
    return p.select(
        "k", "p_size", key.alias("study_key"), F.expr("CAST(1 + k % 2 AS INT)").alias("version"), F.sha2(key, 256).alias("digest"), F.expr("date_add(DATE'1992-01-01', CAST(k % 30 AS INT))").alias("development_from"),
        F.expr("IF(k % 19 = 0, DATE'1991-12-31', DATE'1998-12-31')").alias("development_to"), F.expr("IF(k % 11 = 0, DATE'1998-06-01', DATE'1999-01-01')").alias("oos_from"),
        F.lit("2001-08-31").cast("date").alias("oos_to"),
    )


def _registered(specs: DataFrame) -> DataFrame:
    return specs.filter("k % 4 <> 0").select("study_key", "version", F.expr("IF(k % 5 = 0, sha2('other', 256), digest)").alias("digest"))


def register_studies(spark: SparkSession, d: str) -> DataFrame:
    s = _specs(spark, d)
    return registry.register_studies(s, _registered(s))


def stage_status(spark: SparkSession, d: str) -> DataFrame:
    s = _specs(spark, d)
    both = s.withColumn("stage", F.explode(F.array(F.lit("development"), F.lit("oos"))))
    asked = both.select("study_key", "version", "stage", "digest", F.expr("concat('r', k % 2)").alias("rule_sha"), F.expr("concat('x', k, stage)").alias("result_sha"))
    kept = both.filter("(stage = 'development' AND k % 3 <> 0) OR (stage = 'oos' AND k % 6 = 1)")
    results = kept.select(
        "study_key", "version", "stage", F.expr("IF(stage = 'oos', 2, 1)").alias("generation"), F.expr("concat('r', (k + IF(k % 7 = 0, 1, 0)) % 2)").alias("rule_sha"),
        F.expr("IF(k % 2 = 0, concat('x', k, stage), 'y')").alias("result_sha"),
    )
    return registry.stage_status(asked, _registered(s), results)


def evidence_digests(spark: SparkSession, d: str) -> DataFrame:
    return registry.evidence_digest(fx.bars(fx.events(spark, d)))


def stale_reprocess_plan(spark: SparkSession, d: str) -> DataFrame:
    """Evening bars of some events without coverage have arrived since."""
    e = fx.events(spark, d)
    late = e.withColumn("post_covered", F.expr("post_covered OR k % 2 = 0"))
    rows = lambda x: reaction.reaction_features(x, fx.unfolded(x)).join(registry.evidence_digest(fx.bars(x)), list(KEY))
    return registry.stale_reprocess_plan(rows(e), rows(late))


def spec_violations(spark: SparkSession, d: str) -> DataFrame:
    return registry.spec_violations(_specs(spark, d))


def result_violations(spark: SparkSession, d: str) -> DataFrame:
    r = _specs(spark, d).select(
        "study_key", "version", F.lit(1).alias("generation"), (F.col("p_size") + 10).alias("universe_count"), F.col("p_size").alias("included_count"), F.expr("IF(k % 11 = 0, 11, 10)").alias("excluded_count"),
        F.expr("IF(k % 2 = 0, 'development', 'oos')").alias("stage"), F.expr("CASE WHEN k % 2 = 1 OR k % 13 = 0 THEN 1 END").alias("development_generation"),
        F.expr("IF(k % 3 = 0, 'paper_trade_candidate', 'reject')").alias("decision"), F.expr("k % 17 <> 0").alias("sample_gate"), F.lit(True).alias("coverage_gate"),
    )
    return registry.result_violations(r)


def supersession_violations(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d).select(
        *KEY, F.expr("CASE WHEN superseded THEN earnings_date END").alias("superseded_at"), F.expr("CASE WHEN superseded THEN IF(k % 3 = 0, ' ', 'moved') END").alias("superseded_reason"),
        F.expr("CASE WHEN superseded AND k % 5 <> 0 AND k % 2 = 1 THEN earnings_date WHEN superseded AND k % 10 <> 0 THEN date_add(earnings_date, 7) END").alias("superseded_by_date"),
    )
    return registry.supersession_violations(e)


def cycle_violations(spark: SparkSession, d: str) -> DataFrame:
    c = fx.ticks(spark, d).groupBy(F.date_trunc("hour", "event_timestamp").alias("started")).agg(F.bool_or(F.col("event_type") == "error").alias("bad"))
    status = F.when(~F.hour("started").between(15, 20), "inactive").when(F.col("bad"), "degraded").otherwise("success")
    c = c.select("started", status.alias("status"), F.expr("IF(bad, 'TimeoutError', NULL)").alias("error_kind"), F.expr("IF(bad AND hour(started) <> 16, 'failed', NULL)").alias("error_message"))
    return registry.cycle_violations(c, ["started"])


QUERIES = {
    f.__name__: f
    for f in (
        landed_calendar, landed_rejects, landed_session_bars, retrieval_mismatches, history_collection, landed_quotes, realized_moves, today_snapshot, captured_pending,
        capture_candidates, active_symbols, clean_notes, path_tail, development_split, operations_snapshot, register_studies, stage_status, evidence_digests,
        stale_reprocess_plan, spec_violations, result_violations, supersession_violations, cycle_violations,
    )
}

# --- the same results in SQL ---

_EB = f"WITH {fx.DUCK_EVENTS}, {fx.DUCK_BARS}"
_R = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
_LIVE = "hour = 'amc' AND NOT illiquid AND NOT superseded"
_SPEC = """WITH spec AS (SELECT p_partkey AS k, p_size, 'P' || p_partkey AS study_key, CAST(1 + p_partkey % 2 AS INT) AS version, sha256('P' || p_partkey) AS digest FROM part),
reg AS (SELECT study_key, version, CASE WHEN k % 5 = 0 THEN sha256('other') ELSE digest END AS known FROM spec WHERE k % 4 <> 0)"""
_BROKEN = lambda *pairs: " UNION ALL ".join(f"SELECT *, '{name}' AS rule FROM x WHERE {cond}" for cond, name in pairs)
_MICRO = " || ':' || ".join(f"CAST(round({c} * 1000000) AS BIGINT)" for c in _PRICES)

ORACLE_SQL = {
    "landed_calendar": f"""WITH {fx.DUCK_EVENTS} SELECT symbol, earnings_date AS date, hour, round(eps_estimate, 6) AS eps_estimate, round(eps_actual, 6) AS eps_actual,
CAST(NULL AS DOUBLE) AS revenue_estimate, CAST(NULL AS DOUBLE) AS revenue_actual, CAST(quarter AS SMALLINT) AS quarter, CAST(year AS SMALLINT) AS year FROM ev
QUALIFY min(k) OVER (PARTITION BY symbol, year) % 43 <> 0""",
    "landed_rejects": f"WITH {fx.DUCK_EVENTS} SELECT symbol, CAST(year AS INT) AS year FROM ev GROUP BY ALL HAVING min(k) % 43 = 0",
    "landed_session_bars": f"""{_EB} SELECT symbol, ts, CASE WHEN k % 53 = 0 THEN 'regular' ELSE 'extended' END AS session, earnings_date + CASE WHEN k % 47 = 0 THEN 1 ELSE 0 END AS evidence_date,
{_R(*_PRICES)}, volume, CAST(earnings_date AS TIMESTAMP) + INTERVAL 21 HOUR AS gateway_received_at, '/v1/session-history' AS gateway_endpoint, 'minute' AS frequency,
'historical_backfill' AS collection_mode FROM bar WHERE phase = 'earnings_postmarket' AND k % 43 <> 0""",
    "retrieval_mismatches": f"""WITH {fx.DUCK_EVENTS} SELECT symbol AS asked_symbol, earnings_date AS asked_date, 'extended' AS asked_session,
concat_ws(',', CASE WHEN k % 47 = 0 THEN 'date' END, CASE WHEN k % 53 = 0 THEN 'session' END) AS wrong FROM ev WHERE post_covered AND k % 43 <> 0 AND (k % 47 = 0 OR k % 53 = 0)""",
    "history_collection": f"""{_EB} SELECT DISTINCT symbol, ts, 'unknown' AS session, CAST(ts AS DATE) AS evidence_date, round(close, 6) AS close, volume,
CAST(earnings_date AS TIMESTAMP) + INTERVAL 22 HOUR AS gateway_received_at, 'minute' AS frequency FROM bar WHERE k % 41 <> 0 AND symbol IN (SELECT symbol FROM ev WHERE NOT illiquid)""",
    "landed_quotes": f"""WITH {fx.DUCK_TICKS} SELECT symbol, earnings_date, event_timestamp, received_at AS gateway_received_at, {_R("last", "bid", "ask")}, volume, stale,
'after_hours' AS capture_window, CAST(NULL AS VARCHAR) AS exchange_status FROM tick""",
    "realized_moves": f"""{_EB}, {fx.DUCK_FOLLOWING}, c AS (SELECT symbol, earnings_date, phase, minute, open, close FROM bar
  UNION ALL SELECT symbol, earnings_date, phase, minute, close, close FROM fol WHERE phase = 'following_regular'),
a AS (SELECT symbol, earnings_date, arg_max(close, minute) FILTER (phase = 'earnings_regular') AS pre_close, arg_max(close, minute) FILTER (phase = 'earnings_postmarket') AS ah_close,
  arg_min(open, minute) FILTER (phase = 'following_regular') AS post_open, arg_max(close, minute) FILTER (phase = 'following_regular') AS post_close FROM c GROUP BY ALL)
SELECT ev.symbol, ev.earnings_date, {_R("pre_close", "ah_close", "post_open", "post_close")}, round((ah_close - pre_close) / pre_close * 100, 6) AS reaction_move,
round((post_open - pre_close) / pre_close * 100, 6) AS gap_move, round((post_close - pre_close) / pre_close * 100, 6) AS total_move,
round(CASE WHEN eps_estimate <> 0 THEN (eps_actual - eps_estimate) / eps_estimate * 100 END, 6) AS eps_surprise
FROM ev LEFT JOIN a ON ev.symbol = a.symbol AND ev.earnings_date = a.earnings_date WHERE k % 43 <> 0 AND k % 47 <> 0""",
    "today_snapshot": f"""{core._U}, q0 AS (SELECT symbol, earnings_date, k, minute, close FROM bar WHERE phase = 'earnings_postmarket' AND minute % 15 = 0 AND id = 0
  QUALIFY row_number() OVER (PARTITION BY symbol, earnings_date ORDER BY minute DESC) = 1),
q AS (SELECT symbol, earnings_date, minute AS received_at, close - 5e-2 AS bid, CASE WHEN k % 31 <> 0 THEN close + 5e-2 END AS ask, close AS last, k % 41 = 0 AS quote_stale, (k + minute) % 90 AS age,
  CASE WHEN k % 4 = 1 THEN ['wide_spread', 'stale'] WHEN k % 7 = 2 THEN ['stale', 'late'] END AS qf FROM q0),
m AS (SELECT DISTINCT symbol, earnings_date, phase, minute, close FROM bar),
p0 AS (SELECT *, arg_max(close, minute) FILTER (phase = 'earnings_regular') OVER (PARTITION BY symbol, earnings_date) AS pre FROM m),
p1 AS (SELECT *, CASE WHEN phase <> 'earnings_regular' THEN (close - pre) / pre * 100 END AS cr FROM p0),
p AS (SELECT symbol, earnings_date, max(pre) AS pc, arg_max(cr, minute) FILTER (cr IS NOT NULL) AS provisional_move, max(minute) FILTER (cr IS NOT NULL) AS last_minute, count(cr) AS minutes,
  min(minute) FILTER (abs(cr) >= 2) + 1 AS cross_minute, arg_min(cr, minute) FILTER (abs(cr) >= 2) AS cross_pct FROM p1 GROUP BY ALL),
s AS (SELECT u.symbol, u.earnings_date, u.eps_surprise, pc AS pre_close, bid, ask, last, received_at, quote_stale, age, qf, ask - bid AS spread, (ask - bid) / ((bid + ask) / 2) * 100 AS spread_pct, provisional_move,
  last_minute, minutes, cross_minute, cross_pct, CASE WHEN year(u.earnings_date) < 1998 THEN u.reaction_class END AS reaction_class
  FROM u LEFT JOIN p ON u.symbol = p.symbol AND u.earnings_date = p.earnings_date LEFT JOIN q ON u.symbol = q.symbol AND u.earnings_date = q.earnings_date)
SELECT symbol, earnings_date, {_R("eps_surprise", "pre_close", "bid", "ask", "last", "spread", "spread_pct", "provisional_move", "cross_pct")}, received_at, last_minute, minutes, cross_minute,
reaction_class IS NOT NULL AS final, reaction_class, concat_ws(',', CASE WHEN received_at IS NULL THEN 'no_quote' END, CASE WHEN quote_stale THEN 'stale_quote' END,
CASE WHEN age > 60 THEN 'old_quote' END, CASE WHEN pre_close IS NULL THEN 'no_pre_close' END, nullif(array_to_string(list_filter(qf, lambda f: NOT (quote_stale AND f = 'stale')), ','), ''), CASE WHEN reaction_class IS NULL THEN 'not_final' END) AS degraded FROM s""",
    "captured_pending": f"WITH {fx.DUCK_EVENTS} SELECT symbol, earnings_date, CASE WHEN post_covered THEN 'captured' ELSE 'pending' END AS state FROM ev WHERE {_LIVE}",
    "capture_candidates": f"WITH {fx.DUCK_EVENTS} SELECT symbol, earnings_date FROM ev WHERE {_LIVE} AND NOT post_covered",
    "active_symbols": f"""WITH {fx.DUCK_EVENTS}, {core._CAL}, w AS (SELECT day, previous, next FROM cal WHERE day IN (SELECT earnings_date FROM ev))
SELECT DISTINCT day, symbol FROM ev JOIN w ON earnings_date BETWEEN previous AND next WHERE {_LIVE}""",
    "clean_notes": """SELECT conv_id, turn, trim(role) AS author, CASE WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE trim(text) END AS body, lower(trim(role)) || ';turn' || turn % 3 AS tags,
CASE WHEN (conv_id + turn) % 7 = 0 OR coalesce(trim(text), '') = '' THEN 'body' END AS rejected FROM conversations""",
    "path_tail": f"""{_EB}, l AS (SELECT *, max(minute) FILTER (phase = 'earnings_regular') OVER (PARTITION BY symbol, earnings_date) AS last FROM bar)
SELECT symbol, earnings_date, minute, round(close, 6) AS close, CASE WHEN phase = 'earnings_regular' THEN 'regular_tail' ELSE 'postmarket' END AS part
FROM l WHERE phase <> 'earnings_regular' OR minute > last - 30""",
    "development_split": f"""WITH {fx.DUCK_EVENTS}, e AS (SELECT min(earnings_date) AS a, max(earnings_date) AS b FROM ev), c AS (SELECT a, b, b - CAST(round_even((b - a) * 3e-1, 0) AS INT) AS cut FROM e)
SELECT a AS development_from, cut - 1 AS development_to, cut AS oos_from, b AS oos_to FROM c""",
    "operations_snapshot": f"""WITH {fx.DUCK_EVENTS}, {fx.DUCK_TICKS}, {fx.DUCK_DAILY} SELECT * FROM
(SELECT count(*) AS quotes, max(received_at) AS newest_quote, count(*) FILTER (stale) AS stale_quotes FROM tick),
(SELECT count(*) AS events, max(earnings_date) AS newest_event, count(*) FILTER (illiquid) AS illiquid, count(*) FILTER (superseded) AS superseded FROM ev),
(SELECT count(*) AS daily_bars, max(session_date) AS newest_session FROM daily)""",
    "register_studies": f"""{_SPEC} SELECT spec.study_key, spec.version, digest, CASE WHEN known <> digest THEN 'conflict' WHEN known IS NOT NULL THEN 'already_present' ELSE 'inserted' END AS status
FROM spec LEFT JOIN reg ON spec.study_key = reg.study_key AND spec.version = reg.version""",
    "stage_status": f"""{_SPEC}, a AS (SELECT spec.*, stage, known, k % 3 <> 0 AS has_dev, k % 6 = 1 AS has_oos FROM spec CROSS JOIN (VALUES ('development'), ('oos')) v(stage)
  LEFT JOIN reg ON spec.study_key = reg.study_key AND spec.version = reg.version),
s AS (SELECT *, CASE WHEN known IS DISTINCT FROM digest THEN 'plan_not_registered' WHEN stage = 'oos' AND NOT has_dev THEN 'sealed' WHEN has_dev AND k % 7 = 0 THEN 'rule_differs'
  WHEN k % 2 = 0 AND ((stage = 'development' AND has_dev) OR (stage = 'oos' AND has_oos)) THEN 'already_present' WHEN stage = 'oos' AND has_oos THEN 'already_evaluated' ELSE 'ready' END AS status FROM a)
SELECT study_key, version, stage, status, CAST(CASE WHEN status = 'ready' THEN CASE WHEN has_oos THEN 3 WHEN has_dev THEN 2 ELSE 1 END END AS INT) AS generation FROM s""",
    "evidence_digests": f"""{_EB}, r AS (SELECT symbol, earnings_date, phase || ':' || minute || ':' || {_MICRO} || ':' || volume AS t FROM bar)
SELECT symbol, earnings_date, sha256(string_agg(t, chr(10) ORDER BY t)) AS evidence_sha256 FROM r GROUP BY ALL""",
    "stale_reprocess_plan": f"""WITH {fx.DUCK_EVENTS.replace("k % 19 <> 0 AS post_covered", "(k % 19 <> 0 OR k % 2 = 0) AS post_covered")}, {fx.DUCK_BARS}, {core._SIGNAL}, {core._FEATURES}
SELECT ev.symbol, ev.earnings_date, CASE WHEN k % 2 = 0 THEN 'retract_and_insert' ELSE 'unchanged' END AS action, CASE WHEN k % 2 = 0 THEN reaction_class END AS reaction_class
FROM ev JOIN feat ON ev.symbol = feat.symbol AND ev.earnings_date = feat.earnings_date WHERE k % 19 = 0""",
    "spec_violations": f"""{_SPEC}, x AS (SELECT *, DATE '1992-01-01' + CAST(k % 30 AS INT) AS df, CASE WHEN k % 19 = 0 THEN DATE '1991-12-31' ELSE DATE '1998-12-31' END AS dt,
  CASE WHEN k % 11 = 0 THEN DATE '1998-06-01' ELSE DATE '1999-01-01' END AS oos FROM spec), y AS ({_BROKEN(("df > dt", "development_reversed"), ("oos <= dt", "periods_overlap"))})
SELECT study_key, version, rule FROM y""",
    "result_violations": f"""{_SPEC}, x AS (SELECT *, 1 AS generation FROM spec), y AS ({_BROKEN(("k % 11 = 0", "counts_differ"), ("k % 26 = 0", "stage_and_generation"), ("k % 51 = 0", "promoted_past_gate"))})
SELECT study_key, version, CAST(generation AS INT) AS generation, rule FROM y""",
    "supersession_violations": f"""WITH {fx.DUCK_EVENTS}, x AS (SELECT * FROM ev WHERE superseded), y AS ({_BROKEN(("k % 10 = 0", "half_set"), ("k % 10 <> 0 AND k % 3 = 0", "blank_reason"), ("k % 5 <> 0 AND k % 2 = 1", "own_date"))})
SELECT symbol, earnings_date, rule FROM y""",
    "cycle_violations": f"""WITH {fx.DUCK_TICKS}, x AS (SELECT date_trunc('hour', event_timestamp) AS started, hour(date_trunc('hour', event_timestamp)) BETWEEN 15 AND 20 AS active, bool_or(event_type = 'error') AS bad FROM tick GROUP BY 1, 2),
y AS ({_BROKEN(("active AND bad AND hour(started) = 16", "degraded_without_error"), ("NOT active AND bad", "error_without_degraded"))}) SELECT started, rule FROM y""",
}
