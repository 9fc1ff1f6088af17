"""Streaming jobs against their batch forms; landed texts that are broken, empty or repeated."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import registry, selection
from tidemark.plans import operations
from tidemark.sources import calendar as cal
from tidemark.sources import fixtures as fx
from tidemark.sources import landed
from tidemark.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Ticks in three files, read in time order."""
    t = fx.ticks(spark, SF)
    t = t.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp")).withColumn("received_at", F.col("received_at").cast("timestamp"))
    t = t.withColumn("earnings_date", F.to_date("event_timestamp"))
    path = str(tmp_path_factory.mktemp("ticks"))
    for k in range(3):
        t.filter(F.pmod("event_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(path)
    return t, spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cycles_count_each_batch_once(spark, source, tmp_path):
    t, stream = source
    q, c = f"{tmp_path}/q", f"{tmp_path}/c"
    live.stream_cycles(stream, q, c, f"{tmp_path}/k", ["event_id"]).awaitTermination()
    live.stream_cycles(stream, q, c, f"{tmp_path}/again", ["event_id"]).awaitTermination()  # a replay from the start
    got = spark.read.parquet(c)
    assert got.count() == 3 and got.agg(F.sum("inserted")).first()[0] == t.count() == spark.read.parquet(q).count()
    assert registry.cycle_violations(got, ["batch"]).count() == 0


def test_streamed_bars_and_coverage(spark, tmp_path):
    texts = operations._session_texts(spark, SF).select("value")
    src, bars, cover = (f"{tmp_path}/{x}" for x in ("src", "bars", "cover"))
    texts.write.text(src)
    stream = spark.readStream.text(src)
    for k in ("a", "b"):
        live.stream_bars(stream, bars, cover, f"{tmp_path}/{k}", "earnings_postmarket", 105).awaitTermination()
    batch = landed.session_bars(texts).select("symbol", "ts", "session", "gateway_received_at", "close").dropDuplicates(["symbol", "ts", "session", "gateway_received_at"])
    assert rows(spark.read.parquet(bars).select(*batch.columns)) == rows(batch)
    c = spark.read.parquet(cover)
    assert c.count() == landed.session_bars(texts).select("symbol", "evidence_date").distinct().count() and c.filter("observed > 105 OR mode <> 'scheduled_capture'").count() == 0


def test_window_and_captured(spark, source, tmp_path):
    t, stream = source
    days = cal.calendar(spark, 2020, 2027)
    x = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2026-11-27 15:49:59'), (TIMESTAMP_NTZ'2026-11-27 15:50:00'), (TIMESTAMP_NTZ'2026-11-26 16:00:00') v(event_timestamp)")
    assert [str(r[0]) for r in live.in_window(x, days).collect()] == ["2026-11-27 15:50:00"]
    live.stream_captured(stream, f"{tmp_path}/o", f"{tmp_path}/k").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/o").select("symbol", "earnings_date")) == rows(t.filter("last IS NOT NULL").select("symbol", "earnings_date").distinct())


def test_broken_texts(spark):
    good = '{"earningsCalendar":[{"symbol":"A","date":"2026-11-27","epsEstimate":1.5,"other":1},{"date":"2026-11-27"}]}'
    x = spark.createDataFrame([(good,), ("{",), ("",), (None,), ("[]",), ('{"earningsCalendar":[]}',), ('{"x":1}',)], "value string")
    got = landed.calendar_entries(x).collect()
    assert [(r["symbol"], r["eps_estimate"], r["hour"]) for r in got] == [("A", 1.5, None)]
    assert landed.rejected(x, landed.CALENDAR, "earningsCalendar").count() == 5
    with pytest.raises(ValueError):
        landed.session_bars(x, "guessed")


def test_notes_and_digests(spark):
    n = spark.createDataFrame([(" a ", " b ", [" X", "x", None, "", "y"]), ("a", " ", None), (None, "b", [])], "author string, body string, tags array<string>")
    got = selection.clean_notes(n).collect()
    assert [(r["author"], r["body"], r["tags"], r["rejected"]) for r in got] == [("a", "b", ["x", "y"], None), ("a", "", [], "body"), (None, "b", [], "author")]
    b = fx.bars(fx.events(spark, SF))
    one = registry.evidence_digest(b)
    assert rows(one) == rows(registry.evidence_digest(b.repartition(7, "minute")))
    assert one.join(registry.evidence_digest(b.filter("minute <> -5")), ["symbol", "earnings_date", "evidence_sha256"]).count() == 0


def test_registration_conflicts(spark):
    s = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], "study_key string, version int, digest string")
    known = spark.createDataFrame([("c", 1, "other")], s.schema)
    assert rows(registry.register_studies(s, known).select("study_key", "status")) == [("a", "inserted"), ("b", "conflict"), ("c", "conflict")]
