"""Studies as tables: registration, stage preconditions, reprocessing of stale features, and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import reasons
from .reaction import KEY

STUDY = ["study_key", "version"]


def register_studies(specs: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per study of specs: `inserted`, `already_present`, or `conflict` if its key has another digest, there or within specs."""
    s = specs.groupBy(*STUDY).agg(F.min("digest").alias("digest"), F.max("digest").alias("other"))
    j = s.join(registry.select(*STUDY, F.col("digest").alias("known")), STUDY, "left")
    status = F.when((F.col("digest") != F.col("other")) | (F.col("known") != F.col("digest")), "conflict").when(F.col("known").isNotNull(), "already_present").otherwise("inserted")
    return j.select(*STUDY, "digest", status.alias("status"))


def stage_status(asked: DataFrame, registry: DataFrame, results: DataFrame) -> DataFrame:
    """Whether each asked evaluation (study, stage, digest, rule_sha, result_sha) may be stored, and its generation if so.

    The first that holds: `plan_not_registered`, `sealed` (out of sample without a development result), `rule_differs` (either stage, from the
    latest development result), `already_present`, `already_evaluated` (out of sample only once), else `ready`.
    """
    dev, oos = F.col("stage") == "development", F.col("stage") == "oos"
    r = results.groupBy(*STUDY).agg(
        F.max("generation").alias("last"), F.max_by("rule_sha", F.when(dev, F.col("generation"))).alias("frozen"), F.bool_or(dev).alias("has_dev"), F.bool_or(oos).alias("has_oos")
    )
    same = results.select(*STUDY, "stage", "result_sha").distinct().withColumn("stored", F.lit(True))
    j = asked.join(registry.select(*STUDY, F.col("digest").alias("plan")), STUDY, "left").join(r, STUDY, "left").join(same, [*STUDY, "stage", "result_sha"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(~F.col("plan").eqNullSafe(F.col("digest")), "plan_not_registered").when(oos & ~yes("has_dev"), "sealed")
        .when(F.col("frozen") != F.col("rule_sha"), "rule_differs").when(yes("stored"), "already_present").when(oos & yes("has_oos"), "already_evaluated").otherwise("ready")
    )
    return j.select(*STUDY, "stage", status.alias("status"), F.when(status == "ready", F.coalesce("last", F.lit(0)) + 1).alias("generation"))


def evidence_digest(bars: DataFrame) -> DataFrame:
    """SHA-256 over the bars of each event, whatever their order; prices count to six decimals. An event's bars are bounded by its minutes."""
    micro = [F.round(F.col(c) * 1_000_000).cast("long").cast("string") for c in ("open", "high", "low", "close")]
    row = F.concat_ws(":", "phase", F.col("minute").cast("string"), *micro, F.col("volume").cast("string"))
    return bars.groupBy(*KEY).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("evidence_sha256"))


def stale_reprocess_plan(stored: DataFrame, recomputed: DataFrame, reason: str = "phase_not_covered") -> DataFrame:
    """For live rows that lacked coverage: `unchanged` if their evidence is as it was, else `retract_and_insert` with the new class.

    stored: event, reaction_class, reason, evidence_sha256; recomputed: event, reaction_class, evidence_sha256. Events that are
    no longer there are left alone. Callers append the retraction and the new row; nothing is updated in place.
    """
    old = stored.filter((F.col("reaction_class") == "insufficient_data") & (F.col("reason") == reason)).select(*KEY, F.col("evidence_sha256").alias("old"))
    j = old.join(recomputed.select(*KEY, "reaction_class", F.col("evidence_sha256").alias("new")), list(KEY))
    changed = ~F.col("old").eqNullSafe(F.col("new"))
    return j.select(*KEY, F.when(changed, "retract_and_insert").otherwise("unchanged").alias("action"), F.when(changed, F.col("reaction_class")).alias("reaction_class"))


def violations(rows: DataFrame, key: list[str], *rules: tuple[Column, str]) -> DataFrame:
    """key and rule of every row that breaks a rule (a condition that must not hold; null counts as holding for no row)."""
    return rows.select(*key, F.explode(reasons(*rules)).alias("rule"))


def spec_violations(specs: DataFrame) -> DataFrame:
    """Study plans with reversed or overlapping periods, or a digest that is none."""
    overlap = (F.col("oos_from") <= F.col("development_to")) & (F.col("development_from") <= F.col("oos_to"))
    return violations(
        specs, STUDY, (F.col("development_from") > F.col("development_to"), "development_reversed"), (F.col("oos_from") > F.col("oos_to"), "oos_reversed"),
        (overlap, "periods_overlap"), (~F.col("digest").rlike("^[0-9a-f]{64}$"), "bad_digest"),
    )


def result_violations(results: DataFrame) -> DataFrame:
    """Study results whose counts do not add up, whose stage and development generation do not pair, or that are promoted past a gate."""
    dev, gen = F.col("stage") == "development", F.col("development_generation")
    gates = F.col("sample_gate") & F.col("coverage_gate")
    return violations(
        results, [*STUDY, "generation"], (F.col("universe_count") != F.col("included_count") + F.col("excluded_count"), "counts_differ"),
        (dev == gen.isNotNull(), "stage_and_generation"), ((F.col("decision") == "paper_trade_candidate") & ~gates, "promoted_past_gate"),
    )


def supersession_violations(events: DataFrame) -> DataFrame:
    """Events whose supersession is half set, has a blank reason or names the event's own date."""
    at, why, by = F.col("superseded_at"), F.col("superseded_reason"), F.col("superseded_by_date")
    some, every = at.isNotNull() | why.isNotNull() | by.isNotNull(), at.isNotNull() & why.isNotNull() & by.isNotNull()
    return violations(events, list(KEY), (some & ~every, "half_set"), (every & (F.trim(why) == ""), "blank_reason"), (every & (by == F.col("earnings_date")), "own_date"))


def cycle_violations(cycles: DataFrame, key: list[str]) -> DataFrame:
    """Monitor cycles whose status and error fields do not pair."""
    bad, kind, text = F.col("status") == "degraded", F.col("error_kind"), F.col("error_message")
    return violations(cycles, key, (bad & (kind.isNull() | text.isNull()), "degraded_without_error"), (~bad & (kind.isNotNull() | text.isNotNull()), "error_without_degraded"))
