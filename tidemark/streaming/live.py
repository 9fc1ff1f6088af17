"""The live path as Structured Streaming: gated quotes, cycle rows, snapshots that are written only when they change, bars with coverage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import pct_change, row_digest
from ..operators.bars import coverage_summary
from ..operators.ledger import append_counted, written
from ..operators.reaction import THRESHOLD_PCT
from ..sources.landed import session_bars
from .bars import dated, once

#: Wall clock of the capture window, in minutes of the day (fixed values).
WINDOW_OPENS, WINDOW_ENDS = 15 * 60 + 50, 20 * 60 + 15


def _start(df: DataFrame, each, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_window(ticks: DataFrame, days: DataFrame, local: str = "event_timestamp") -> DataFrame:
    """Ticks of the capture window of a session; `local` is exchange wall clock. days: the calendar (one row a day)."""
    sessions = days.filter("is_session").select(F.col("day").alias("_day"))
    minute = F.hour(local) * 60 + F.minute(local)
    t = ticks.filter(minute.between(WINDOW_OPENS, WINDOW_ENDS))
    return t.join(F.broadcast(sessions), F.to_date(local) == F.col("_day")).drop("_day")


def stream_cycles(ticks: DataFrame, quotes: str, cycles: str, checkpoint: str, key: list[str], days: DataFrame | None = None, by: str = "earnings_date") -> StreamingQuery:
    """Quotes into a ledger, and a row per micro-batch: batch, status, candidates, fetched, inserted, conflicted, error_kind, error_message.

    With days (the calendar) only quotes of the capture window are stored, and a batch without any is `inactive`. A batch that holds an `error` tick is
    `degraded`, an empty one `no_candidates`. A batch as idle as the one before it (`inactive`, `no_candidates`) adds no row. Quotes are stored under
    their batch number, and `inserted` is what stands under it: a batch that is replayed, even one that failed between the two writes, adds nothing
    twice and tells the numbers of the first time. The ledger is partitioned by `by` (see bars.dated), cycles by thousands of batches; a batch reads the
    folders of its own days and the newest cycles. CycleListener adds the row of a query that failed.
    """

    def each(df: DataFrame, batch: int) -> None:
        inside = dated(df if days is None else in_window(df, days), by)
        inserted, conflicted = append_counted(inside, quotes, key, by, batch)
        c = inside.agg(F.count("*").alias("fetched"), F.countDistinct("symbol").alias("candidates"), F.coalesce(F.bool_or(F.col("event_type") == "error"), F.lit(False)).alias("bad"))
        idle = "no_candidates" if days is None or df.isEmpty() else "inactive"
        status = F.when(F.col("fetched") == 0, idle).when(F.col("bad"), "degraded").otherwise("success")
        row = c.select(
            F.lit(batch).cast("long").alias("batch"), status.alias("status"), "candidates", "fetched", F.lit(inserted).cast("long").alias("inserted"), F.lit(conflicted).cast("long").alias("conflicted"),
            F.when(F.col("bad"), "feed_error").alias("error_kind"), F.when(F.col("bad"), "request failed").alias("error_message"), F.lit(batch // CYCLES_A_PART).cast("int").alias("part"),
        )
        was = _status_before(row, cycles, batch)
        row = row.filter(~(F.col("status").isin("inactive", "no_candidates") & F.col("status").eqNullSafe(F.lit(was))))
        append_counted(row, cycles, ["batch"], "part")

    return _start(ticks, each, checkpoint)


#: Cycles in one folder of their table.
CYCLES_A_PART = 1000


def _status_before(row: DataFrame, cycles: str, batch: int) -> str | None:
    """Status of the last cycle row before a batch; idle batches leave none, so older folders are looked at until one has a row."""
    for part in range(batch // CYCLES_A_PART, -1, -1):
        there = written(row.sparkSession, f"{cycles}/part={part}", row.schema, cycles)
        if there is not None:
            last = there.filter(F.col("batch") < batch).agg(F.max_by("status", "batch")).first()[0]
            if last is not None:
                return last
    return None


class CycleListener(StreamingQueryListener):
    """Appends a `degraded` cycle, with the error's kind and first line, when a query ends with an error. spark.streams.addListener(CycleListener(spark, path))."""

    def __init__(self, spark: SparkSession, cycles: str):
        self.spark, self.cycles, self.batches = spark, cycles, {}

    def onQueryStarted(self, event) -> None:
        self.batches[str(event.id)] = -1

    def onQueryProgress(self, event) -> None:
        self.batches[str(event.progress.id)] = event.progress.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            row = (self.batches.get(str(event.id), -1) + 1, "degraded", 0, 0, 0, 0, event.errorClassOnException or "stream_failed", event.exception.strip().splitlines()[0][:500])
            self.spark.createDataFrame([(*row, row[0] // CYCLES_A_PART)], CYCLE).write.mode("append").partitionBy("part").parquet(self.cycles)


CYCLE = "batch long, status string, candidates long, fetched long, inserted long, conflicted long, error_kind string, error_message string, part int"


def snapshots(ticks: DataFrame, pre_close: DataFrame, threshold: float = THRESHOLD_PCT) -> DataFrame:
    """Latest quote, move from the reference and first crossing per symbol and day; for batches, and streams in update mode.

    pre_close: symbol, earnings_date, pre_close, joined before the aggregation (stream to table).
    """
    t = ticks.join(pre_close, ["symbol", "earnings_date"], "left").withColumn("cr", pct_change(F.col("pre_close"), F.col("last")))
    order = F.struct("received_at", "event_id")
    hit = F.when(F.abs("cr") >= threshold, order)
    seen = F.when(F.col("cr").isNotNull(), order)
    s = t.groupBy("symbol", "earnings_date").agg(
        F.max_by(F.struct("received_at", "bid", "ask", "last", "stale"), order).alias("q"), F.max_by("cr", seen).alias("move"), F.min(hit).alias("hit"), F.min_by("cr", hit).alias("cross_pct")
    )
    return s.select("symbol", "earnings_date", "q.*", "move", F.col("hit.received_at").alias("cross_at"), "cross_pct")


#: A snapshot as snapshots() gives it, and what is kept of a key: its parts with the order of the ticks they come from, and what was told last.
SNAPSHOT = "symbol string, earnings_date date, received_at timestamp, bid double, ask double, last double, stale boolean, move double, cross_at timestamp, cross_pct double"
_KEPT = "seen timestamp, seen_id long, bid double, ask double, last double, stale boolean, moved timestamp, moved_id long, move double, hit timestamp, hit_id long, cross_pct double, told boolean"


def _step(threshold: float):
    """The state function of changed_snapshots(): folds a key's new ticks into its state, gives the snapshot if it differs from the one told last."""
    plain = lambda v: None if v is None or v is pd.NaT or v != v else v

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = list(state.get) if state.exists else [None] * 13
        now = list(had)
        later = lambda at, old: old[0] is None or tuple(at) > (pd.Timestamp(old[0]), old[1])
        for x in frames:
            x = x.sort_values(["received_at", "event_id"])
            tail = x.iloc[-1]
            if later((tail["received_at"], tail["event_id"]), now[0:2]):
                now[0:6] = [tail["received_at"], int(tail["event_id"]), *[plain(tail[c]) for c in ("bid", "ask", "last", "stale")]]
            moves = x[x["cr"].notna()]
            if len(moves):
                m = moves.iloc[-1]
                if later((m["received_at"], m["event_id"]), now[6:8]):
                    now[6:9] = [m["received_at"], int(m["event_id"]), float(m["cr"])]
                hits = moves[moves["cr"].abs() >= threshold]
                if len(hits):
                    h = hits.iloc[0]
                    if now[9] is None or (h["received_at"], h["event_id"]) < (pd.Timestamp(now[9]), now[10]):
                        now[9:12] = [h["received_at"], int(h["event_id"]), float(h["cr"])]
        show = lambda s: [plain(s[i]) for i in (0, 2, 3, 4, 5, 8, 9, 11)]
        state.update((*[None if plain(v) is None else v.to_pydatetime() if isinstance(v, pd.Timestamp) else bool(v) if i == 5 else v for i, v in enumerate(now[:12])], True))
        if had[12] is None or show(had) != show(now):
            yield pd.DataFrame([[*key, *show(now)]], columns=[c.split()[0] for c in SNAPSHOT.split(", ")]).astype({"received_at": "datetime64[ns]", "cross_at": "datetime64[ns]"})

    return step


def changed_snapshots(ticks: DataFrame, pre_close: DataFrame, threshold: float = THRESHOLD_PCT) -> DataFrame:
    """snapshots() of a stream, each key's row only when it differs from the one given last, which is kept as the key's state.

    A micro-batch touches the keys that it has ticks of and no others; what was given before is never read again.
    """
    t = ticks.join(pre_close, ["symbol", "earnings_date"], "left").withColumn("cr", pct_change(F.col("pre_close"), F.col("last")))
    t = t.select("symbol", "earnings_date", "received_at", F.col("event_id").cast("long"), *[F.col(c).cast("double") for c in ("bid", "ask", "last")], "stale", "cr")
    return t.groupBy("symbol", "earnings_date").applyInPandasWithState(_step(threshold), SNAPSHOT, _KEPT, "update", GroupStateTimeout.NoTimeout)


def stream_changed(ticks: DataFrame, pre_close: DataFrame, path: str, checkpoint: str, threshold: float = THRESHOLD_PCT) -> StreamingQuery:
    """changed_snapshots() into a table with a folder for each micro-batch (column `batch`); a replayed batch writes its own folder anew."""

    def each(df: DataFrame, batch: int) -> None:
        df.withColumn("digest", row_digest("snapshot", *[c for c in df.columns if c not in ("symbol", "earnings_date")])).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return _start(changed_snapshots(ticks, pre_close, threshold), each, checkpoint, "update")


def stream_bars(landed: DataFrame, bars: str, coverage: str, checkpoint: str, phase: str, expected_minutes: int, mode: str = "scheduled_capture") -> StreamingQuery:
    """Landed session histories into the bar ledger, and a coverage row for each retrieval of an event's phase; both partitioned by date."""

    def each(df: DataFrame, batch: int) -> None:
        rows = session_bars(df, mode)
        append_counted(rows, bars, ["symbol", "ts", "session", "gateway_endpoint", "gateway_received_at"], "evidence_date", batch)
        first = F.min("ts").over(_by("symbol", "evidence_date", "gateway_received_at"))
        x = rows.select("symbol", F.col("evidence_date").alias("earnings_date"), F.lit(phase).alias("phase"), "gateway_received_at", F.timestamp_diff("MINUTE", first, F.col("ts")).alias("minute"))
        key = ["symbol", "earnings_date", "phase"]
        latest = x.withColumn("newest", F.max("gateway_received_at").over(_by(*key))).filter("gateway_received_at = newest")
        asked = latest.select(*key, "newest").distinct().withColumn("expected_minutes", F.lit(expected_minutes))
        done = coverage_summary(latest, asked.drop("newest")).join(asked.select(*key, F.col("newest").alias("retrieved_at")), key).withColumn("mode", F.lit(mode))
        append_counted(done, coverage, [*key, "retrieved_at"], "earnings_date", batch)

    return _start(landed, each, checkpoint)


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def stream_captured(ticks: DataFrame, path: str, checkpoint: str, memory: str = "1 hour") -> StreamingQuery:
    """Events for which a quote with a last price was seen, each written once: repeats end in the state store, later ones at the day's folder."""
    key = ["symbol", "earnings_date"]

    def each(df: DataFrame, batch: int) -> None:
        append_counted(df, path, key, "earnings_date", batch)

    return _start(once(ticks.filter("last IS NOT NULL").select(*key), key, memory), each, checkpoint)
