"""Append-only sinks and ledgers: upserts, new rows, replacement and reconciliation as joins."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def upsert_events(stored: DataFrame, new: DataFrame, key: list[str], keep: list[str], renew: list[str]) -> DataFrame:
    """Full outer merge: `keep` columns stay as stored where set, `renew` columns take the new value where set; is_new marks new keys."""
    s = stored.select(*key, *[F.col(c).alias(f"_s_{c}") for c in keep + renew], F.lit(True).alias("_s"))
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in keep + renew])
    return s.join(n, key, "full").select(
        *key, *[F.coalesce(f"_s_{c}", f"_n_{c}").alias(c) for c in keep], *[F.coalesce(f"_n_{c}", f"_s_{c}").alias(c) for c in renew], F.col("_s").isNull().alias("is_new")
    )


def new_rows(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append: one per key, none whose key exists. Null keys are equal to each other."""
    had = existing.select(*[F.col(c).alias(f"__{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return rows.dropDuplicates(key).join(had, same, "left_anti")


def written(spark: SparkSession, path: str, schema: StructType | None = None, base: str | None = None) -> DataFrame | None:
    """The Parquet table at path (a folder of the table at `base`, if given), None if there is none yet. Any other error of the read is raised."""
    read = spark.read if schema is None else spark.read.schema(schema)
    try:
        return (read if base is None else read.option("basePath", base)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


#: Values of the partition column up to which a ledger's folders are read one by one, unlisted beside them.
MOST_FOLDERS = 64


def stored_rows(rows: DataFrame, path: str, schema: StructType, by: str | None = None) -> DataFrame | None:
    """What a ledger holds in the partitions (column `by`, a date or whole number) that `rows` have values of; None if nothing.

    Only the folders of those values are listed and read, however many the ledger has; beyond MOST_FOLDERS values the filter on the
    partition column leaves the other files unread. Without `by`: all of it.
    """
    spark = rows.sparkSession
    if by is None:
        return written(spark, path, schema)
    values = [r[0] for r in rows.select(by).distinct().limit(MOST_FOLDERS + 1).collect()]
    if len(values) > MOST_FOLDERS:
        old = written(spark, path, schema)
        return None if old is None else old.join(F.broadcast(rows.select(F.col(by).alias("__by")).distinct()), F.col(by).eqNullSafe(F.col("__by")), "left_semi")
    found = None
    for v in values:
        part = written(spark, f"{path}/{by}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}", schema, path)
        found = part if found is None or part is None else found.unionByName(part)
        found = part if found is None else found
    return found


def append_ledger(rows: DataFrame, path: str, key: list[str], by: str | None = None) -> int:
    """Append new_rows() to a Parquet ledger; running it again adds nothing. Returns how many were added (append_counted() tells the rest)."""
    return append_counted(rows, path, key, by)[0]


def append_counted(rows: DataFrame, path: str, key: list[str], by: str | None = None, batch: int | None = None) -> tuple[int, int]:
    """append_ledger() with the numbers inserted and conflicted (offered, but there already or repeated).

    by: a column that the ledger is partitioned by, the same for all rows of a key; only the folders of the rows' values are read then.
    batch: a number that stored rows carry (column `batch`). A batch that is offered again, after it was stored, gives the numbers of the
    first time: what is stored under its number counts as inserted. One writer at a time is assumed.
    """
    rows = (rows if batch is None else rows.withColumn("batch", F.lit(batch).cast("long"))).persist()
    offered = rows.count()
    old = stored_rows(rows, path, rows.schema, by) if offered else None
    fresh = (rows.dropDuplicates(key) if old is None else new_rows(old, rows, key)).persist()  # counted and written as one set
    inserted = fresh.count()
    before = 0
    if old is not None and batch is not None:
        mine = old.filter(F.col("batch") == batch).select(*[F.col(c).alias(f"__{c}") for c in key])
        before = rows.dropDuplicates(key).join(mine, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left_semi").count()
    if inserted:
        (fresh.write.mode("append") if by is None else fresh.write.mode("append").partitionBy(by)).parquet(path)
    fresh.unpersist()
    rows.unpersist()
    return inserted + before, offered - inserted - before


def append_observed(rows: DataFrame, path: str, key: list[str], by: str | None = None, status: str = "analysis_status", skip: str = "not_yet_available") -> dict[str, int]:
    """Append what the ledger lacks, in one pass: scanned, rows of each status, inserted and conflicted are observed while the rows are written.

    Rows of status `skip` are counted, not stored; of several with one key one is stored. The same numbers as evidence.run_summary().
    """
    old = stored_rows(rows, path, rows.schema, by)
    first = Window.partitionBy(*key).orderBy(F.col(status) == skip)
    x = rows.withColumn("__n", F.row_number().over(first))
    if old is None:
        x = x.withColumn("__known", F.lit(None).cast("boolean"))
    else:
        had = old.select(*[F.col(c).alias(f"__k_{c}") for c in key], F.lit(True).alias("__known")).dropDuplicates([f"__k_{c}" for c in key])
        x = x.join(had, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in key], "left").drop(*[f"__k_{c}" for c in key])
    kept = ~F.col(status).eqNullSafe(skip)
    new = kept & F.col("__known").isNull() & (F.col("__n") == 1)
    seen = Observation(f"append_{uuid.uuid4().hex}")
    by_status = [F.count_if(F.col(status) == s).alias(s) for s in ("complete", "no_trigger_in_window", "insufficient_data", "not_yet_available")]
    x = x.observe(seen, F.count(F.lit(1)).alias("scanned"), *by_status, F.count_if(new).alias("inserted"), F.count_if(kept & ~F.coalesce(new, F.lit(False))).alias("conflicted"))
    fresh = x.filter(new).drop("__n", "__known")
    (fresh.write.mode("append") if by is None else fresh.write.mode("append").partitionBy(by)).parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def upsert_ledger(new: DataFrame, path: str, key: list[str], keep: list[str], renew: list[str], by: str) -> int:
    """upsert_events() into a Parquet table partitioned by `by`, a column of the key: only partitions that `new` has values of are read and
    overwritten, files of all others stay as they are. Of repeated keys in `new` one counts. Returns how many keys are new.
    """
    new = new.dropDuplicates(key).select(*key, *keep, *renew)
    old = stored_rows(new, path, new.schema, by)
    merged = upsert_events(new.limit(0) if old is None else old, new, key, keep, renew).persist()
    added = merged.filter("is_new").count()
    out = merged.select(*new.columns)
    # written from what was read before anything is replaced
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    merged.unpersist()
    return added


def coverage_now(arrivals: DataFrame, key: list[str]) -> DataFrame:
    """The valid coverage row of each key: its first row if that is a backfill, else its latest scheduled one."""
    a = arrivals.groupBy(*key).agg(
        F.min_by(F.struct("mode", "retrieved_at"), "retrieved_at").alias("first"),
        F.max_by(F.struct("mode", "retrieved_at"), F.when(F.col("mode") == "scheduled_capture", F.col("retrieved_at"))).alias("last"),
    )
    return a.select(*key, F.when(F.col("first.mode") == "historical_backfill", F.col("first")).otherwise(F.col("last")).alias("x")).select(*key, "x.*")


def liquidity(daily: DataFrame, lookback: int = 10) -> DataFrame:
    """Mean of close * volume over each symbol's last sessions; Spark keeps `lookback` rows per symbol and task before it shuffles."""
    w = Window.partitionBy("symbol").orderBy(F.col("session_date").desc())
    d = daily.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= lookback)
    return d.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("dollar_volume"), F.count("*").alias("sessions"))


def reconcile_plan(events: DataFrame, listings: DataFrame) -> DataFrame:
    """What to do with recorded events given the current calendar, by fiscal quarter.

    supersede: the quarter is listed once, on another date; reinstate: a superseded event is listed on its own date.
    Quarters that are not listed, or on several dates, or not known (null year or quarter), say nothing.
    """
    key = ["symbol", "year", "quarter"]
    sure = listings.groupBy(*key).agg(F.min("date").alias("listed"), F.max("date").alias("other")).filter(F.col("listed") == F.col("other")).drop("other")
    j = events.join(sure, key)
    action = F.when((F.col("listed") != F.col("earnings_date")) & ~F.col("superseded"), "supersede").when((F.col("listed") == F.col("earnings_date")) & F.col("superseded"), "reinstate")
    why = F.when(action == "supersede", F.format_string("Q%d of %d is listed on %s", F.col("quarter").cast("int"), F.col("year").cast("int"), F.date_format("listed", "yyyy-MM-dd")))
    return j.withColumns({"action": action, "reason": why}).filter("action IS NOT NULL").select("symbol", "earnings_date", "action", "listed", "reason")


#: Days around a symbol's events within which listings are looked up (fixed value).
LOOKUP_DAYS = 75


def unlisted_events(events: DataFrame, fetched: DataFrame, start: str, end: str) -> DataFrame:
    """Live after-close events of a window of days that the listings fetched for it do not name on their date."""
    live = events.filter((F.col("hour") == "amc") & ~F.col("superseded") & F.col("earnings_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return live.join(fetched.select("symbol", F.col("date").alias("earnings_date")), ["symbol", "earnings_date"], "left_anti")


def reconcile_window(events: DataFrame, fetched: DataFrame, lookup: DataFrame, start: str, end: str) -> DataFrame:
    """reconcile_plan() after a refresh of a window of days. For symbols with an unlisted live event in it, `lookup` (all listings of a symbol) adds those
    within LOOKUP_DAYS of the symbol's unlisted events; events of symbols without any evidence are left alone.

    The lookup is an equi-join on the symbol with the span of days as a residual."""
    gone = unlisted_events(events, fetched, start, end).groupBy("symbol").agg(F.date_sub(F.min("earnings_date"), LOOKUP_DAYS).alias("_from"), F.date_add(F.max("earnings_date"), LOOKUP_DAYS).alias("_to"))
    found = lookup.join(gone, "symbol").filter(F.col("date").between(F.col("_from"), F.col("_to"))).select(*fetched.columns)
    evidence = fetched.unionByName(found)
    recorded = events.filter("hour = 'amc'").join(evidence.select("symbol").distinct(), "symbol", "left_semi")
    return reconcile_plan(recorded, evidence)


def latest_actions(actions: DataFrame, key: list[str], at: str = "at") -> DataFrame:
    """Of a ledger of actions the one in force for each key: the last by time, of several at one time the last by name."""
    return actions.groupBy(*key).agg(F.max(F.struct(at, "action")).alias("x")).select(*key, "x.*")


def liquidity_decisions(events: DataFrame, rows: DataFrame, dollar_volume: DataFrame, floor: float) -> DataFrame:
    """What to do with each event whose live feature row is insufficient and that is not excluded yet: `exclude` under the floor, `keep` from it
    on, `inconclusive` (kept too) without a volume.

    rows: live feature rows; dollar_volume: liquidity()."""
    backlog = events.filter(~F.col("illiquid")).join(rows.filter("analysis_status = 'insufficient_data'").select("symbol", "earnings_date"), ["symbol", "earnings_date"])
    j = backlog.join(dollar_volume, "symbol", "left")
    decision = F.when(F.col("dollar_volume").isNull(), "inconclusive").when(F.col("dollar_volume") < floor, "exclude").otherwise("keep")
    # halves to the even number, as SQL's printf does, and off the last digits, which sums in another order may change
    whole = F.bround(F.round("dollar_volume", 6)).cast("long")
    why = F.when(decision == "exclude", F.format_string("mean dollar volume %d is under %.0f", whole, F.lit(float(floor))))
    return j.select("symbol", "earnings_date", decision.alias("decision"), why.alias("reason"))
