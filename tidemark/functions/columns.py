"""Scalar rules as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pct_change(before: Column, after: Column) -> Column:
    """Percent change; null if either side is null or the base is 0."""
    return F.when(before != 0, (after - before) / before * 100)


def surprise_pct(actual: Column, estimate: Column) -> Column:
    """Surprise over the size of the estimate, whatever its sign; null for no or zero estimate."""
    return F.when(estimate != 0, (actual - estimate) / F.abs(estimate) * 100)


def retention(last_return: Column, initial_return: Column) -> Column:
    return F.when(initial_return != 0, last_return / initial_return)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds (null counts as false), in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))


def first_reason(*pairs: tuple[Column, str]) -> Column:
    """The text of the first condition that holds, else null."""
    return F.coalesce(*[F.when(c, F.lit(t)) for c, t in pairs])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def merge_flags(*flags: Column) -> Column:
    """Union of flag arrays in order of first sight; null arrays are empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(f, none) for f in flags]))


def bar_problem(open_: Column, high: Column, low: Column, close: Column, volume: Column | None = None) -> Column:
    """Why a bar is not usable, or null. NaN sorts above all numbers in Spark, so it is asked first."""
    prices = [open_, high, low, close]
    bad = lambda f: reduce(lambda a, b: a | b, [f(p) for p in prices])
    pairs = [
        (bad(lambda p: p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))), "non_finite_price"),
        (bad(lambda p: p <= 0), "non_positive_price"),
        ((low > F.least(open_, close)) | (high < F.greatest(open_, close)) | (high < low), "inconsistent_range"),
    ]
    if volume is not None:
        pairs.append((volume.isNull() | (volume < 0), "invalid_volume"))
    return first_reason(*pairs)


def stale_is_fatal(stale: Column, received: Column, phase_end: Column) -> Column:
    """A stale retrieval counts only if it came before the phase ended, or its time is unknown."""
    return stale & (received.isNull() | (received < phase_end))


def norm_symbol(raw: Column) -> Column:
    """Upper-case, trimmed symbol, or null if it is not one."""
    s = F.upper(F.trim(raw))
    return F.when(s.rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$"), s)


def eastern(ts: Column) -> Column:
    """Wall clock in New York of a UTC timestamp."""
    return F.from_utc_timestamp(ts, "America/New_York")


def canonical_text(*cols: str) -> Column:
    """The named columns as JSON, sorted by name, nulls kept."""
    return F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})


def only_finite(df: DataFrame, text: Column) -> Column:
    """text, or an error in rows in which a floating-point column of df is NaN or infinite: such rows have no canonical text."""
    odd = [F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c, t in df.dtypes if t in ("double", "float")]
    bad = reduce(lambda a, b: a | b, odd, F.lit(False))
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a value that is not finite has no canonical text")).cast("string")).otherwise(text)


def row_digest(schema: str, *cols: str) -> Column:
    """SHA-256 of a schema tag and canonical_text()."""
    return F.sha2(F.concat(F.lit(schema), F.lit("\n"), canonical_text(*cols)), 256)
