"""Streams into ledgers: replays, crashes between writes, reads bounded by the batch, changes kept as state, the open bar closed by a mark."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence as ev
from tidemark.operators import ledger
from tidemark.operators.bars import changed_snapshots, minute_bars
from tidemark.sources import fixtures as fx
from tidemark.streaming import bars as sb
from tidemark.streaming import live

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 3, 4, 15, 0)
TICK = "event_id long, symbol string, earnings_date date, event_timestamp timestamp, received_at timestamp, event_type string, bid double, ask double, last double, volume long, stale boolean"


def tick(k, symbol="A", minutes=0.0, last=100.0, day=None, kind="view"):
    at = T0 + dt.timedelta(minutes=minutes)
    return (k, symbol, (day or at).date() if isinstance(day or at, dt.datetime) else day, at, at + dt.timedelta(seconds=1), kind, 99.0, None if k % 3 else 101.0, last, k * 10, k % 5 == 0)


def put(spark, path, rows):
    """A file of a source; files are read in the order of their times."""
    spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(path)
    for n, f in enumerate(sorted(Path(path).glob("*.parquet"), key=os.path.getmtime)):
        os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))


def source(spark, path):
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def spoil(folder):
    """Files that fail whoever reads them."""
    for f in Path(folder).glob("*.parquet"):
        f.write_text("not a table")
    for f in Path(folder).glob(".*.crc"):
        f.unlink()


def test_repeats_end_in_state_and_at_the_ledger(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/quotes"
    old, new = dt.date(2024, 3, 1), dt.date(2024, 3, 4)
    put(spark, src, [tick(1, day=old), tick(1, day=old), tick(2, day=old)])
    put(spark, src, [tick(3, day=new), tick(2, day=old)])
    sb.stream_quotes(source(spark, src), out, f"{tmp_path}/c", ["event_id"]).awaitTermination()
    assert rows(spark.read.parquet(out).select("event_id", "batch")) == [(1, 0), (2, 0), (3, 1)]
    spoil(f"{out}/earnings_date={old}")  # a batch that has rows of another day reads none of these
    put(spark, src, [tick(3, day=new), tick(4, day=new), tick(1, day=old)])  # tick 1 ends in the state store
    sb.stream_quotes(source(spark, src), out, f"{tmp_path}/c", ["event_id"]).awaitTermination()
    assert rows(spark.read.parquet(f"{out}/earnings_date={new}").select("event_id")) == [(3,), (4,)]
    with pytest.raises(Exception):  # a new run without that state asks the old day's folder
        sb.stream_quotes(source(spark, src), out, f"{tmp_path}/again", ["event_id"]).awaitTermination()


def test_other_runs_meet_the_ledger(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/quotes"
    put(spark, src, [tick(k, f"S{k % 3}", k) for k in range(20)] * 2)
    for c in ("a", "b"):
        sb.stream_quotes(source(spark, src), out, f"{tmp_path}/{c}", ["event_id"]).awaitTermination()
    assert spark.read.parquet(out).count() == 20


def test_many_days_of_one_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "MOST_FOLDERS", 2)
    r = spark.createDataFrame([(k, dt.date(2024, 3, 1 + k % 5) if k % 5 else None) for k in range(10)], "k int, day date")
    assert [ledger.append_counted(r, f"{tmp_path}/x", ["k"], "day", b) for b in (0, 0, 1)] == [(10, 0), (10, 0), (0, 10)]


def test_a_crash_between_the_writes_keeps_the_numbers(spark, tmp_path, monkeypatch):
    src, q, c = (f"{tmp_path}/{x}" for x in ("in", "q", "c"))
    put(spark, src, [tick(1), tick(2), tick(2)])
    put(spark, src, [tick(2), tick(3, "B"), tick(4, kind="error")])
    plain, calls = live.append_counted, []

    def once_broken(rows, path, *rest):
        calls.append(path)
        if len(calls) == 4:  # the second batch's cycle row, its quotes being stored
            raise OSError("disk full")
        return plain(rows, path, *rest)

    monkeypatch.setattr(live, "append_counted", once_broken)
    with pytest.raises(Exception):
        live.stream_cycles(source(spark, src), q, c, f"{tmp_path}/k", ["event_id"]).awaitTermination()
    assert spark.read.parquet(q).count() == 4 and spark.read.parquet(c).count() == 1
    live.stream_cycles(source(spark, src), q, c, f"{tmp_path}/k", ["event_id"]).awaitTermination()
    got = rows(spark.read.parquet(c).select("batch", "status", "candidates", "fetched", "inserted", "conflicted"))
    assert got == [(0, "success", 1, 3, 2, 1), (1, "degraded", 2, 3, 2, 1)]
    live.stream_cycles(source(spark, src), q, c, f"{tmp_path}/other", ["event_id"]).awaitTermination()  # replayed from the start
    assert rows(spark.read.parquet(c).select("batch", "status", "candidates", "fetched", "inserted", "conflicted")) == got


def test_cycles_look_back_over_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "CYCLES_A_PART", 2)
    src, q, c = (f"{tmp_path}/{x}" for x in ("in", "q", "c"))
    from tidemark.sources import calendar as cal

    for k, minutes in enumerate((-300, -299, -298, -297, -296, 60, -290)):
        put(spark, src, [tick(k, minutes=minutes)])
    live.stream_cycles(source(spark, src), q, c, f"{tmp_path}/k", ["event_id"], cal.calendar(spark, 2024, 2024)).awaitTermination()
    assert rows(spark.read.parquet(c).select("batch", "status")) == [(0, "inactive"), (5, "success"), (6, "inactive")]


def test_snapshots_are_told_when_they_change(spark, tmp_path):
    src, out, spare = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/spare"
    a = [tick(1, "A", 1, 100.0), tick(2, "A", 2, 101.0), tick(3, "B", 2, None), tick(30, None, 1, 5.0)]
    b = [tick(4, "A", 1.5, 103.0), tick(5, "B", 3, 98.0), tick(2, "A", 2, 101.0)]  # an earlier crossing, and a repeat
    c = [tick(6, "B", 1, 90.0), tick(7, "C", 1, 50.0), tick(8, "A", 0, None)]  # an earlier crossing, no reference, nothing new
    d = [tick(1, "A", 1, 100.0), tick(9, "C", 0.5, 50.0)]  # no change
    pre = spark.createDataFrame([("A", T0.date(), 100.0), ("B", T0.date(), 100.0)], "symbol string, earnings_date date, pre_close double")
    seen = []
    for n, part in enumerate((a, b, c, d)):
        put(spark, src, part)
        seen.append(live.snapshots(spark.createDataFrame([t for x in (a, b, c, d)[: n + 1] for t in x], TICK), pre).withColumn("batch", F.lit(n)))
    for stop in (1, 2, 3, 4):  # a restart after each batch
        live.stream_changed(source(spark, src).limit(10**9) if stop < 0 else source(spark, src), pre, out, f"{tmp_path}/k").awaitTermination()
    every = seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])
    key = ["symbol", "earnings_date"]
    want = changed_snapshots(every, key, ["batch"], [x for x in every.columns if x not in (*key, "batch")])
    got = spark.read.parquet(out)
    assert rows(got.select(*want.columns)) == rows(want) and got.filter("batch = 3").count() == 0
    live.stream_changed(source(spark, src), pre, spare, f"{tmp_path}/k2").awaitTermination()
    assert rows(spark.read.parquet(spare).select(*want.columns)) == rows(want)
    spoil(f"{out}/batch=0")  # what was told before is not read again
    put(spark, src, [tick(20, "A", 9, 120.0)])
    live.stream_changed(source(spark, src), pre, out, f"{tmp_path}/k").awaitTermination()
    assert rows(spark.read.parquet(f"{out}/batch=4").select("symbol", "last")) == [("A", 120.0)]


def test_last_snapshot_equals_batch(spark, tmp_path):
    t = fx.ticks(spark, SF).withColumns({"event_timestamp": F.col("event_timestamp").cast("timestamp"), "received_at": F.col("received_at").cast("timestamp")})
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(3):
        t.filter(F.pmod("event_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(src)
    pre = t.groupBy("symbol", "earnings_date").agg(F.avg("last").alias("pre_close"))
    live.stream_changed(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src), pre, out, f"{tmp_path}/k").awaitTermination()
    got = spark.read.parquet(out).groupBy("symbol", "earnings_date").agg(F.max_by(F.struct("*"), "batch").alias("x")).select("x.*").drop("digest", "batch")
    assert rows(got.select(*[F.round(c, 6) if k == "double" else F.col(c) for c, k in got.dtypes])) == rows(live.snapshots(t, pre).select(*[F.round(c, 6) if k == "double" else F.col(c) for c, k in got.dtypes]))


def test_a_mark_closes_the_open_bar(spark, tmp_path):
    src, marks, out, c = (f"{tmp_path}/{x}" for x in ("in", "marks", "out", "c"))
    first = [tick(k, "AB"[k % 2], k / 4, 100.0 + k) for k in range(40)]
    put(spark, src, first)
    os.makedirs(marks)
    run = lambda: sb.stream_minute_bars(spark.readStream.schema(TICK).parquet(src), out, c, marks=spark.readStream.schema(sb.MARK).parquet(marks)).awaitTermination()
    run()
    open_ = spark.createDataFrame(first, TICK).agg(F.max(F.date_trunc("MINUTE", "event_timestamp"))).first()[0]
    got = spark.read.parquet(out)
    assert got.count() and got.filter(F.col("bar_ts") >= F.lit(open_)).count() == 0
    sb.mark_time(spark, marks, str(open_ + dt.timedelta(minutes=5)))
    run()
    put(spark, src, [tick(99, "A", 9.9, 500.0)])  # late for the bar that the mark closed
    sb.mark_time(spark, marks, str(open_ + dt.timedelta(minutes=9)))
    run()
    assert rows(spark.read.parquet(out)) == rows(minute_bars(spark.createDataFrame(first, TICK), time="event_timestamp"))


def test_appended_rows_are_counted_in_one_pass(spark, tmp_path):
    x = spark.createDataFrame([(k, dt.date(2024, 3, 1 + k % 2), ("complete", "insufficient_data", "not_yet_available")[k % 3]) for k in range(12)] + [(0, dt.date(2024, 3, 1), "complete")], "k int, day date, analysis_status string")
    path, key = f"{tmp_path}/x", ["k", "day"]
    stored = x.filter("k < 5 AND analysis_status <> 'not_yet_available'").dropDuplicates(key)
    want = ev.run_summary(x.dropDuplicates(key), stored, key).first().asDict()
    assert ledger.append_counted(stored, path, key, "day") == (4, 0)
    got = ledger.append_observed(x, path, key, "day")
    assert got == want | {"scanned": 13, "complete": 5, "conflicted": want["conflicted"] + 1}
    assert spark.read.parquet(path).count() == 8
    again = ledger.append_observed(x, path, key, "day")
    assert (again["scanned"], again["inserted"], again["conflicted"]) == (13, 0, 9) and spark.read.parquet(path).count() == 8


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    path, schema = f"{tmp_path}/x", "symbol string, day date, est double, act double"
    one, two = dt.date(2024, 3, 1), dt.date(2024, 3, 2)
    up = lambda r: ledger.upsert_ledger(spark.createDataFrame(r, schema), path, ["symbol", "day"], ["est"], ["act"], "day")
    assert up([("A", one, 1.0, None), ("B", two, None, 2.0), ("B", two, None, 2.0)]) == 2
    files = lambda d: sorted(f.name for f in Path(f"{path}/day={d}").glob("*.parquet"))
    before, other = files(one), files(two)
    assert up([("B", two, 5.0, 3.0), ("C", two, 1.0, 1.0)]) == 1
    assert files(one) == before and files(two) != other
    assert rows(spark.read.parquet(path).select("symbol", "day", "est", "act")) == [("A", one, 1.0, None), ("B", two, 5.0, 3.0), ("C", two, 1.0, 1.0)]
    assert up([("C", two, None, None)]) == 0 and rows(spark.read.parquet(path).filter("symbol = 'C'").select("est", "act")) == [(1.0, 1.0)]
