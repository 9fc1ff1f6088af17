"""Calendar rules, exports and integrity checks on small inputs."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.operators import integrity
from tidemark.sources import calendar, exports

D = dt.date


def test_holidays_and_early_closes_of_2024(spark):
    days = calendar.calendar(spark, 2024, 2024)
    shut = {r["day"] for r in days.filter(~F.col("is_session") & (F.weekday("day") < 5)).collect()}
    assert shut == {D(2024, 1, 1), D(2024, 1, 15), D(2024, 2, 19), D(2024, 3, 29), D(2024, 5, 27), D(2024, 6, 19), D(2024, 7, 4), D(2024, 9, 2), D(2024, 11, 28), D(2024, 12, 25)}
    assert {r["day"] for r in days.filter("early_close").collect()} == {D(2024, 7, 3), D(2024, 11, 29), D(2024, 12, 24)}


def test_neighbours_and_overrides(spark):
    over = spark.createDataFrame([(D(2024, 3, 5), False, False)], "day date, is_session boolean, early_close boolean")
    row = lambda days, d: days.filter(F.col("day") == d).first()
    sunday = row(calendar.calendar(spark, 2024, 2024), D(2024, 3, 31))
    assert (sunday["previous"], sunday["next"], sunday["latest"]) == (D(2024, 3, 28), D(2024, 4, 1), D(2024, 3, 28))
    monday = row(calendar.calendar(spark, 2024, 2024, over), D(2024, 3, 4))
    assert (monday["previous"], monday["next"], monday["latest"]) == (D(2024, 3, 1), D(2024, 3, 6), D(2024, 3, 4))


def test_bounds_follow_daylight_time_and_early_close(spark):
    e = spark.createDataFrame([("A", D(2024, 3, 8)), ("B", D(2024, 11, 29)), ("C", D(2024, 3, 9))], "symbol string, earnings_date date")
    got = {(r["symbol"], r["phase"]): (r["expected_start"], r["expected_end"]) for r in calendar.phase_bounds(e, calendar.calendar(spark, 2024, 2024)).collect()}
    assert got["A", "earnings_regular"] == (dt.datetime(2024, 3, 8, 14, 30), dt.datetime(2024, 3, 8, 21))
    assert got["A", "following_regular"] == (dt.datetime(2024, 3, 11, 13, 30), dt.datetime(2024, 3, 11, 20))
    assert got["B", "earnings_postmarket"] == (dt.datetime(2024, 11, 29, 18), dt.datetime(2024, 11, 30, 1))
    assert ("C", "earnings_regular") not in got and ("C", "following_premarket") in got


def test_exports(spark, tmp_path):
    df = spark.sql("SELECT 'x' AS b, array('p', 'q') AS a, named_struct('z', 1, 'y', CAST(NULL AS INT)) AS s, DATE '2024-03-04' AS d, CAST(NULL AS STRING) AS n")
    exports.write_csv(df, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()
    assert text[0] == "b,a,s,d,n" and text[1].startswith("x,p;q,")
    exports.write_jsonl(df, str(tmp_path / "j"))
    line = next((tmp_path / "j").glob("*.json")).read_text().strip()
    assert list(json.loads(line)) == ["a", "b", "d", "n", "s"] and json.loads(line)["s"] == '{"y":null,"z":1}' and json.loads(line)["n"] is None
    exports.write_csv(df.filter("b = ''"), str(tmp_path / "e"))
    assert any(x.read_text().startswith("b,a,s,d,n") for x in (tmp_path / "e").glob("*.csv"))
    exports.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()


def test_integrity(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert [tuple(r) for r in integrity.repeated_keys(old, ["k"]).collect()] == [(1, 2)]
    assert [tuple(r) for r in integrity.orphans(old, old.filter("k = 1"), ["k"]).collect()] == [(2, 1)]
    assert integrity.changed_rows(old, old.unionByName(old)).isEmpty()
    assert [tuple(r) for r in integrity.changed_rows(old, old.distinct()).collect()] == [(1, "a")]
