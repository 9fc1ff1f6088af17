"""Queries over the whole tables: nothing is left out by a number's remainder."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import selection
from tidemark.plans import queries
from tidemark.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_every_weekday_order_makes_an_event(spark):
    o = fx.read(spark, SF, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).filter(F.weekday("day") < 5).distinct()
    want = {(f"C{r['o_custkey']}", r["day"]) for r in o.collect()}
    got = fx.events(spark, SF).select("symbol", "earnings_date", "s", "k").collect()
    assert {(r["symbol"], r["earnings_date"]) for r in got} == want and len(got) == len(want)
    assert {r["s"] for r in got} == set(range(8)) and {r["k"] % 5 for r in got} == set(range(5))
    assert queries.QUERIES["reaction_features"](spark, SF).count() == len(want)


def test_odd_rows_are_offered(spark):
    rest = fx.read(spark, SF, "events").filter("event_id % 3 <> 0")
    assert queries.append_only_new_rows(spark, SF).count() == rest.count()


def test_daily_context_has_the_full_width(spark):
    day = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([("A", day + dt.timedelta(i), 1) for i in range(200)], "symbol string, session_date date, volume long")
    events = spark.createDataFrame([("A", day + dt.timedelta(i)) for i in (130, 500)], "symbol string, earnings_date date")
    rel = {}
    for r in selection.daily_context(events, daily).collect():
        rel.setdefault(r["earnings_date"], []).append(r["rel"])
    assert sorted(rel[day + dt.timedelta(130)]) == list(range(-120, 31))
    assert sorted(rel[day + dt.timedelta(500)]) == list(range(-120, 1))
