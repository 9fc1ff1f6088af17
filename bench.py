"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans import events, queries

QUERIES = queries.QUERIES | events.QUERIES

#: The last five work on coverage rows; each of them is timed with stored tables of its own, from the orders on.
NAMES = (
    "reaction_features", "outcomes", "class_distribution", "checkpoint_asof", "authoritative_bars", "cohort_counts", "study_result", "minute_bars", "liquidity_floor",
    "asof_ticks", "feature_rows", "session_outcomes", "universe", "study_results",
)


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("reaction_features", "study_results"):  # warm-up
        QUERIES[name](spark, sf.replace("sf0.1", "sf0.001")).write.format("noop").mode("overwrite").save()
    took = {}
    for name in NAMES:
        events._KEPT.clear()
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
