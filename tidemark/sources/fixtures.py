"""Study inputs derived from the driver's tables by plain arithmetic, in Spark and (DUCK_*) in SQL for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Percent return of minute m on path s.
PATH = """CASE s WHEN 0 THEN 3 + m / 1e2 WHEN 1 THEN CASE WHEN m < 5 THEN 3e0 ELSE 5e-1 END WHEN 2 THEN CASE WHEN m < 20 THEN 0e0 ELSE 3e0 END
 WHEN 3 THEN CASE WHEN m < 5 THEN 3e0 ELSE -3e0 END WHEN 4 THEN 5e-1 WHEN 5 THEN -3 - m / 1e2 ELSE 3e0 END"""
MISSING = "(s = 0 AND m % 17 = 11) OR (s = 6 AND m >= 95) OR (s = 7 AND m >= 93)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str, part: int | None = None) -> DataFrame:
    """One row per customer and order weekday, of every order: symbol, earnings_date, k, path s, estimates and flags. part: orders of a part, about (EVENTS_PER_PART)."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("earnings_date"), "o_orderkey")
    e = o.filter(F.weekday("earnings_date") < 5).groupBy("o_custkey", "earnings_date").agg(F.min("o_orderkey").alias("k"))
    # events are few bytes but become hundreds of bars each: dealt once by their key, all that is made of them needs no further shuffle on it
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _orders(spark, sf_dir) // (part or EVENTS_PER_PART))
    return _dealt(e, partitions).select(
        "symbol", "earnings_date", "k", F.expr("CAST((k div 5) % 8 AS INT)").alias("s"),
        F.expr("CASE WHEN k % 9 = 0 THEN 'bmo' ELSE 'amc' END").alias("hour"),
        F.expr("CASE WHEN k % 11 <> 0 THEN (k % 200 - 50) / 1e2 END").alias("eps_estimate"),
        F.expr("CASE WHEN k % 11 <> 0 THEN (k % 200 - 50) / 1e2 + (k % 7 - 3) / 1e2 END").alias("eps_actual"),
        F.expr("CASE WHEN k % 6 <> 0 THEN CAST(k % 300 AS DOUBLE) END").alias("revenue_estimate"), F.expr("CASE WHEN k % 6 <> 0 THEN k % 300 + (k % 5 - 2) * 1e0 END").alias("revenue_actual"),
        F.year("earnings_date").alias("year"), F.quarter("earnings_date").alias("quarter"),
        F.expr("k % 13 = 0").alias("illiquid"), F.expr("k % 17 = 0").alias("superseded"), F.expr("k % 19 <> 0").alias("post_covered"),
        F.expr("k % 23 = 5").alias("stale"), F.expr("k % 29 = 0").alias("early_close"), F.expr("k % 31 = 0").alias("backfilled"),
    )


DUCK_EVENTS = """
o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS earnings_date, min(o_orderkey) AS k FROM orders
      WHERE isodow(CAST(o_orderdate AS DATE)) < 6 GROUP BY ALL),
ev AS (
  SELECT 'C' || o_custkey AS symbol, earnings_date, k, CAST((k // 5) % 8 AS INT) AS s, CASE WHEN k % 9 = 0 THEN 'bmo' ELSE 'amc' END AS hour,
         CASE WHEN k % 11 <> 0 THEN (k % 200 - 50) / 1e2 END AS eps_estimate,
         CASE WHEN k % 11 <> 0 THEN (k % 200 - 50) / 1e2 + (k % 7 - 3) / 1e2 END AS eps_actual,
         CASE WHEN k % 6 <> 0 THEN CAST(k % 300 AS DOUBLE) END AS revenue_estimate, CASE WHEN k % 6 <> 0 THEN k % 300 + (k % 5 - 2) * 1e0 END AS revenue_actual,
         year(earnings_date) AS year, quarter(earnings_date) AS quarter, k % 13 = 0 AS illiquid, k % 17 = 0 AS superseded, k % 19 <> 0 AS post_covered,
         k % 23 = 5 AS stale, k % 29 = 0 AS early_close, k % 31 = 0 AS backfilled
  FROM o)"""


#: Orders of a part of events(), about: the bars of a part, some millions at most, are summed up in a task's memory; of a smaller one, where texts of its bars are collected.
EVENTS_PER_PART = 16_000
EVENTS_PER_TEXTS_PART = 4_000
_ORDERS: dict[tuple[str, str], int] = {}


def _orders(spark: SparkSession, sf_dir: str) -> int:
    """How many orders a folder has; parts are cut by it, results do not depend on it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ORDERS:
        _ORDERS[key] = read(spark, sf_dir, "orders").count()
    return _ORDERS[key]


def _dealt(e: DataFrame, partitions: int) -> DataFrame:
    e = e.withColumn("symbol", F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    return e.repartition(partitions, "symbol", "earnings_date")


def bars(evs: DataFrame, first: int = -30, last: int = 104, keep: Sequence[str] = (), minutes: tuple[Column, Column] | None = None) -> DataFrame:
    """Minute bars around the close (minute 0 is the first after it): symbol, earnings_date, phase, minute, ts, prices, volume, id.

    keep: further columns of evs. minutes: only these, of evs' columns. A defect by k % 23: 1 minute 10 twice, 2 high below close at minute 12, 3 no volume, 4 no bar at minute -1."""
    own = F.sequence(F.lit(first), F.lit(last))
    if minutes is not None:
        a, z = F.greatest(F.lit(first), minutes[0]), F.least(F.lit(last), minutes[1])
        own = F.when(minutes[0].isNotNull() & minutes[1].isNotNull() & (a <= z), F.sequence(a, F.greatest(a, z)))
    b = evs.select("symbol", "earnings_date", "k", "s", "post_covered", *keep, F.explode(own).alias("m"))
    at = bars_at("m")
    b = b.filter(at["there"]).withColumn("copy", F.explode(at["ids"])).withColumn("close", at["close"])
    return b.select(
        "symbol", "earnings_date", "k", F.expr("CASE WHEN m < 0 THEN 'earnings_regular' ELSE 'earnings_postmarket' END").alias("phase"), F.col("m").alias("minute"),
        (F.col("earnings_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(16), F.col("m"))).alias("ts"),
        *[at[c].alias(c) for c in ("open", "high", "low")], "close", at["volume"].alias("volume"), F.col("copy").alias("id"), *keep,
    )


#: The rules of bars() over the columns k, s, post_covered and m, the minute: whether an event has the minute, ids of its rows, prices (over close) and volume.
BAR_RULES = {
    "there": f"(m < 0 AND NOT (m = -1 AND k % 23 = 4)) OR (m >= 0 AND post_covered AND NOT ({MISSING}))", "ids": "CASE WHEN k % 23 = 1 AND m = 10 THEN array(0, 1) ELSE array(0) END",
    "close": f"CASE WHEN m < 0 THEN 1e2 ELSE 1e2 * (1 + ({PATH}) / 1e2) END", "open": "close", "high": "CASE WHEN k % 23 = 2 AND m = 12 THEN close - 1e0 ELSE close + 1e-1 END", "low": "close - 1e-1",
    "volume": "CAST(CASE WHEN k % 23 = 3 THEN 0 WHEN m < 0 THEN 100 ELSE 10 + (k + m) % 7 END AS BIGINT)",
}


def rules_at(minute: str, rules: dict[str, str]) -> dict[str, str]:
    """The rules with the minute by that name."""
    return {n: re.sub(r"\bm\b", minute, rule) for n, rule in rules.items()}


def bars_at(minute: str) -> dict[str, Column]:
    return {n: F.expr(rule) for n, rule in rules_at(minute, BAR_RULES).items()}


def unfolded(evs: DataFrame) -> Callable[..., DataFrame]:
    """bars() as reaction.path_measures() unfolds them: given values of the events, the bars with these; given minutes too, only these, which may read values
    (events in which one is null have none). Made in place each time, so no bar is shuffled, sorted or stored."""

    def rows(values: DataFrame | None = None, minutes: tuple[Column, Column] | None = None) -> DataFrame:
        e = evs if values is None else evs.join(values, ["symbol", "earnings_date"], "left")
        return bars(e, keep=[] if values is None else [c for c in values.columns if c not in ("symbol", "earnings_date")], minutes=minutes)

    return rows


DUCK_BARS = f"""
b0 AS (SELECT symbol, earnings_date, k, s, post_covered, CAST(m AS INT) AS m FROM ev, range(-30, 105) r(m)
       WHERE (m < 0 AND NOT (m = -1 AND k % 23 = 4)) OR (m >= 0 AND post_covered AND NOT ({MISSING}))),
b1 AS (SELECT b0.*, c AS id, CASE WHEN m < 0 THEN 1e2 ELSE 1e2 * (1 + ({PATH}) / 1e2) END AS close FROM b0, (VALUES (0), (1)) v(c) WHERE c = 0 OR (k % 23 = 1 AND m = 10)),
bar AS (SELECT symbol, earnings_date, k, CASE WHEN m < 0 THEN 'earnings_regular' ELSE 'earnings_postmarket' END AS phase, m AS minute,
       CAST(earnings_date AS TIMESTAMP) + INTERVAL 16 HOUR + m * INTERVAL 1 MINUTE AS ts, close AS open,
       CASE WHEN k % 23 = 2 AND m = 12 THEN close - 1e0 ELSE close + 1e-1 END AS high, close - 1e-1 AS low, close,
       CAST(CASE WHEN k % 23 = 3 THEN 0 WHEN m < 0 THEN 100 ELSE 10 + (k + m) % 7 END AS BIGINT) AS volume, id FROM b1)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from the events table: cumulative volume, some without a last price or an ask, some stale."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").alias("event_timestamp"),
        (F.col("ts") + F.make_dt_interval(secs=F.expr("event_id % 3"))).alias("received_at"), F.to_date("ts").alias("earnings_date"),
        F.expr("CASE WHEN event_id % 29 <> 0 THEN value END").alias("last"), (F.col("value") * 0.999).alias("bid"),
        F.expr("CASE WHEN event_id % 31 <> 0 THEN value * 1.001e0 END").alias("ask"), (F.col("event_id") * 10).alias("volume"),
        F.expr("event_id % 41 = 0").alias("stale"), "event_id", "event_type",
    )


DUCK_TICKS = """
tick AS (SELECT 'U' || user_id AS symbol, ts AS event_timestamp, ts + (event_id % 3) * INTERVAL 1 SECOND AS received_at, CAST(ts AS DATE) AS earnings_date,
       CASE WHEN event_id % 29 <> 0 THEN value END AS last, value * 999e-3 AS bid, CASE WHEN event_id % 31 <> 0 THEN value * 1001e-3 END AS ask,
       event_id * 10 AS volume, event_id % 41 = 0 AS stale, event_id, event_type FROM events)"""


def following(evs: DataFrame) -> DataFrame:
    """Bars of the next session: premarket each ten minutes (0 to 140), regular minutes 0 to 389 with some missing."""
    pre = evs.select("*", F.lit("following_premarket").alias("phase"), F.explode(F.sequence(F.lit(0), F.lit(140), F.lit(10))).alias("minute"))
    reg = evs.select("*", F.lit("following_regular").alias("phase"), F.explode(F.sequence(F.lit(0), F.lit(389))).alias("minute"))
    at = following_at("minute")
    b = pre.unionByName(reg).filter(at["there"]).withColumn("close", at["close"])
    return b.select("symbol", "earnings_date", "k", "phase", "minute", *[at[c].alias(c) for c in ("open", "high", "low")], "close")


#: The rules of following(), as BAR_RULES; they read the phase.
FOLLOWING_RULES = {
    "there": "phase = 'following_premarket' OR (NOT (k % 37 = 0 AND m BETWEEN 100 AND 114) AND NOT (k % 41 = 0 AND m BETWEEN 200 AND 224))", "ids": "array(0)",
    "close": "CASE WHEN phase = 'following_premarket' THEN CAST(101 + (k + m) % 5 AS DOUBLE) ELSE 1e2 + (k % 9 - 4) + m / 1e2 END", "open": "close", "high": "close + 1", "low": "close - 1", "volume": "CAST(1 AS BIGINT)",
}


def following_at(minute: str) -> dict[str, Column]:
    return {n: F.expr(rule) for n, rule in rules_at(minute, FOLLOWING_RULES).items()}


DUCK_FOLLOWING = """
fol AS (
  SELECT symbol, earnings_date, k, 'following_premarket' AS phase, CAST(m AS INT) AS minute, CAST(101 + (k + m) % 5 AS DOUBLE) AS close FROM ev, range(0, 141, 10) r(m)
  UNION ALL
  SELECT symbol, earnings_date, k, 'following_regular', CAST(m AS INT), 1e2 + (k % 9 - 4) + m / 1e2 FROM ev, range(0, 390) r(m)
  WHERE NOT (k % 37 = 0 AND m BETWEEN 100 AND 114) AND NOT (k % 41 = 0 AND m BETWEEN 200 AND 224))"""


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer and ship date: mean price and quantity."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_quantity")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("o_custkey", F.to_date("l_shipdate").alias("session_date"))
    return j.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume")).select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), "session_date", "close", "volume"
    )


DUCK_DAILY = """
daily AS (SELECT 'C' || o_custkey AS symbol, CAST(l_shipdate AS DATE) AS session_date, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
