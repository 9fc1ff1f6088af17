"""Streaming forms of the batch operators; the same aggregation runs on both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bars import minute_bars
from ..operators.ledger import append_counted

#: A mark says that event time has reached `at`.
MARK = "at timestamp"


def mark_time(spark: SparkSession, path: str, at: str) -> None:
    """Append a mark (a UTC timestamp as text) to the folder that stream_minute_bars() takes marks from: the session's end, say."""
    spark.createDataFrame([(at,)], "at string").select(F.col("at").cast("timestamp")).write.mode("append").parquet(path)


def stream_minute_bars(ticks: DataFrame, path: str, checkpoint: str, delay: str = "1 minute", bucket: str = "1 minute", marks: DataFrame | None = None) -> StreamingQuery:
    """Minute bars of a tick stream, each written once when the watermark passes its end; ticks later than that are dropped.

    marks: a second stream (MARK) whose rows move the watermark as ticks do, but make no bar. A mark `delay` and a bucket beyond the last tick closes the
    bar that is still open, so the stream's own output is whole, and what comes later for that bar is late.
    event_timestamp must be a TIMESTAMP: watermarks refuse TIMESTAMP_NTZ.
    """
    t = ticks.withColumn("is_mark", F.lit(False))
    if marks is not None:
        # with a price, as ticks without one are left out below the watermark
        t = t.unionByName(marks.select(F.col("at").alias("event_timestamp"), F.lit(0.0).alias("last"), F.lit(True).alias("is_mark")), allowMissingColumns=True)
    # names the event time, so that the filter stays above the watermark, which must see the marks
    t = t.withWatermark("event_timestamp", delay).filter(~F.col("is_mark") | F.col("event_timestamp").isNull()).drop("is_mark")
    bars = minute_bars(t, bucket, "event_timestamp")
    return bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dated(ticks: DataFrame, by: str) -> DataFrame:
    """Ticks with the partition column `by`, the day of the event where they lack it."""
    return ticks if by in ticks.columns else ticks.withColumn(by, F.to_date("event_timestamp"))


def once(rows: DataFrame, key: list[str], memory: str) -> DataFrame:
    """Rows of a stream without those whose key arrived within `memory` before, kept in the state store.

    State goes by the time of arrival (that of the micro-batch, which a replay repeats), so no row is ever late and lost.
    """
    return rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", memory).dropDuplicatesWithinWatermark(key).drop("arrived")


def stream_quotes(ticks: DataFrame, path: str, checkpoint: str, key: list[str], by: str = "earnings_date", memory: str = "1 hour") -> StreamingQuery:
    """Idempotent ingestion into a ledger partitioned by the day: repeats that arrive within `memory` end in the state store, older ones and those of
    other runs meet the ledger, of which a micro-batch reads the folders of its own days. Stored rows carry their batch number.
    """

    def each(df: DataFrame, batch: int) -> None:
        append_counted(df, path, key, by, batch)

    return once(dated(ticks, by), key, memory).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
