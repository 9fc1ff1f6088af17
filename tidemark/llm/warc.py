"""WARC: not-modified revisits take the payload of the latest earlier full response of their canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Headers that a 304 may renew (fixed values); all others of a revisit are ignored.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

#: Spans that the time line is cut into, rows of a span beyond which there are more, and how many there can be.
SPANS, SPAN_ROWS, MOST_SPANS = 64, 2_000_000, 1024

#: Captures of one page are so many seconds after its first.
STEP = 1_000_000

_TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)="


def canonical(url: Column) -> Column:
    """A URL without scheme, user, default port, fragment, tracking parameters and final slash; host lowered, parameters sorted.

    Null or empty: null.
    """
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^[^@]*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(_TRACKING)))
    return F.when(F.length(host) > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _etag(c: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(c), r"^W/", "")


def asof_latest(left: DataFrame, right: DataFrame, by: str, ts: str, tie: str, value: Column, spans: int | None = None) -> DataFrame:
    """left with `found`: value of the right row with the latest (ts, tie) before left's ts (strictly), in the same `by`.

    The time line is cut into spans at quantiles; each (by, span) is a window of its own, begun with what the spans
    before it leave behind. There are SPANS spans, or more where right has many rows: one for SPAN_ROWS, MOST_SPANS at most.
    A row with a null `by` or ts finds nothing.
    """
    probes = ",".join(f"{k / MOST_SPANS!r}D" for k in range(1, MOST_SPANS))
    seen = right.select(F.col(ts).cast("double").alias("t")).agg(F.count("t").alias("n"), F.expr(f"percentile_approx(t, array({probes}), {2 * MOST_SPANS})").alias("c")).first()
    spans = spans or min(MOST_SPANS, max(SPANS, -(-seen["n"] // SPAN_ROWS)))
    cuts = [seen["c"][k * MOST_SPANS // spans - 1] for k in range(1, spans)] if seen["n"] else []
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= F.col(ts).cast("double"))) if cuts else F.lit(0)
    r = right.filter(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(F.col(by).alias("__by"), place.alias("__span"), F.col(ts).alias("__ts"), F.col(tie).alias("__tie"), value.alias("__value"))
    last = r.groupBy("__by", "__span").agg(F.max_by("__value", F.struct("__ts", "__tie")).alias("__value"))
    # what the spans before it leave is carried into a span only if something asks there; a key has two rows a span here at most
    asked = left.filter(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(F.col(by).alias("__by"), place.alias("__span")).distinct()
    steps = last.select("__by", "__span", F.lit(1).alias("__kind"), "__value").unionByName(asked.select("__by", "__span", F.lit(0).alias("__kind"), F.lit(None).cast(r.schema["__value"].dataType).alias("__value")))
    before = F.last("__value", ignorenulls=True).over(Window.partitionBy("__by").orderBy("__span", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = steps.withColumn("__value", before).filter((F.col("__kind") == 0) & F.col("__value").isNotNull()).select("__by", "__span", "__value")
    start = carried.select("__by", "__span", F.lit(None).cast(left.schema[ts].dataType).alias("__ts"), F.lit(0).alias("__kind"), F.lit(None).cast(r.schema["__tie"].dataType).alias("__tie"), "__value", F.lit(None).alias("__row"))
    cells = r.select("__by", "__span", "__ts", F.lit(2).alias("__kind"), "__tie", "__value", F.lit(None).alias("__row"))
    asks = left.select(
        F.col(by).alias("__by"), place.alias("__span"), F.col(ts).alias("__ts"), F.lit(1).alias("__kind"), F.lit(None).cast(r.schema["__tie"].dataType).alias("__tie"),
        F.lit(None).cast(r.schema["__value"].dataType).alias("__value"), F.struct(*left.columns).alias("__row"),
    )
    row = left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType
    all_rows = start.withColumn("__row", F.lit(None).cast(row)).unionByName(cells.withColumn("__row", F.lit(None).cast(row))).unionByName(asks)
    w = Window.partitionBy("__by", "__span").orderBy(F.col("__ts").asc_nulls_first(), "__kind", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.when(F.col("__by").isNotNull() & F.col("__ts").isNotNull(), F.last(F.when(F.col("__kind") != 1, F.col("__value")), ignorenulls=True).over(w))
    # rows without a URL would all meet in one window; they find nothing and skip it
    looked = all_rows.filter(F.col("__by").isNotNull()).withColumn("found", found).filter(F.col("__kind") == 1).select("__row.*", "found")
    rest = left.filter(F.col(by).isNull()).withColumn("found", F.lit(None).cast(r.schema["__value"].dataType))
    return looked.unionByName(rest)


def resolve_revisits(responses: DataFrame, revisits: DataFrame, spans: int | None = None) -> DataFrame:
    """One row per revisit, in any order of input.

    responses: record_id, url, ts, digest, headers (map, lower-case names); revisits: record_id, url, ts, headers.
    Returns record_id, canon, ts, response_id, digest, status and headers. status:
    `resolved` (a validator agrees: the entity tag, weakly compared, or without tags on both sides Last-Modified),
    `unverified` (nothing to compare), `mismatch` (validators differ: no payload), `orphan` (no earlier response).
    Merged headers are the response's with the permitted ones of the revisit in their place.
    """
    value = F.struct("record_id", "digest", "headers")
    asks = revisits.select("record_id", canonical(F.col("url")).alias("canon"), "ts", F.col("headers").alias("asked"))
    full = responses.select("record_id", canonical(F.col("url")).alias("canon"), "ts", "digest", "headers")
    out = asof_latest(asks, full, "canon", "ts", "record_id", value, spans)
    ours = F.coalesce("asked", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    theirs = F.coalesce("found.headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    both = lambda name: ours[name].isNotNull() & theirs[name].isNotNull()
    status = (
        F.when(F.col("found").isNull(), "orphan")
        .when(both("etag"), F.when(_etag(ours["etag"]) == _etag(theirs["etag"]), "resolved").otherwise("mismatch"))
        .when(both("last-modified"), F.when(ours["last-modified"] == theirs["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    fresh = F.map_filter(ours, lambda k, v: k.isin(*RENEWED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    out = out.withColumn("status", status)
    good = F.col("status").isin("resolved", "unverified")
    return out.select(
        "record_id", "canon", "ts", F.col("found.record_id").alias("response_id"), F.when(good, F.col("found.digest")).alias("digest"), "status", F.when(good, merged).alias("headers")
    )


def header_text(headers: Column) -> Column:
    """`name: value` lines, sorted by name; null: null."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses and revisits of a crawl, derived from pages: each page is fetched at its id in seconds; a page whose id
    is 3 mod 4 is only asked for again (a revisit of whatever was there); all others are visited twice more, under
    variants of their URL, the second time with a tag that agrees only if the id is not divisible by 5."""
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    first = pages.filter(F.col("page_id") % 4 != 3).select(
        F.col("page_id").alias("record_id"), "url", F.col("page_id").alias("ts"), F.sha1("html").alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("date"), F.col("page_id").cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("server"), F.lit("origin")).alias("headers"),
    )
    again = pages.select("page_id", "url", "html", F.explode(F.array(F.lit(1), F.lit(2))).alias("visit")).filter((F.col("page_id") % 4 != 3) | (F.col("visit") == 1))
    ts = F.when(F.col("page_id") % 4 == 3, F.col("page_id")).otherwise(F.col("page_id") + F.col("visit") * STEP)
    sent = F.when(F.col("visit") == 1, F.concat(F.lit("W/"), tag)).when(F.col("page_id") % 5 == 0, F.lit('"stale"')).otherwise(tag)
    url = F.when(F.col("visit") == 1, F.concat(F.col("url"), F.lit("#again"))).otherwise(F.regexp_replace("url", "^http:", "https:"))
    revisits = again.select(
        (F.col("page_id") * 4 + F.col("visit")).alias("record_id"), url.alias("url"), ts.alias("ts"),
        F.create_map(F.lit("etag"), F.when(F.col("page_id") % 4 != 3, sent), F.lit("date"), ts.cast("string"), F.lit("cache-control"), F.lit("max-age=120"), F.lit("server"), F.lit("edge"), F.lit("content-length"), F.lit("0")).alias("headers"),
    )
    return first, revisits


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resolve_revisits() of captures() of all pages: a row for each revisit; nulls, ties and repeats as they say."""
    responses, revisits = captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    out = resolve_revisits(responses, revisits)
    return out.select("record_id", "canon", "ts", "response_id", "digest", "status", header_text(F.col("headers")).alias("headers"))


_CANON = r"""
  CASE WHEN length(host) > 0 THEN host || regexp_replace(path, '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END END"""

ORACLE = rf"""
WITH rec AS (
  SELECT page_id AS record_id, url, page_id AS ts, sha1(html) AS digest, '"' || md5(html) || '"' AS etag, NULL::BIGINT AS page_id, FALSE AS again
  FROM pages WHERE page_id % 4 <> 3
  UNION ALL
  SELECT page_id * 4 + visit, CASE WHEN visit = 1 THEN url || '#again' ELSE regexp_replace(url, '^http:', 'https:') END,
         CASE WHEN page_id % 4 = 3 THEN page_id ELSE page_id + visit * {STEP} END, NULL,
         CASE WHEN page_id % 4 = 3 THEN NULL WHEN visit = 1 THEN '"' || md5(html) || '"' WHEN page_id % 5 = 0 THEN '"stale"' ELSE '"' || md5(html) || '"' END,
         page_id, TRUE
  FROM pages, (VALUES (1), (2)) v(visit) WHERE page_id % 4 <> 3 OR visit = 1),
cut AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM rec),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', '') AS host,
         regexp_extract(u, '^[^/?]*([^?]*)', 1) AS path,
         list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '{_TRACKING}')) AS kept
  FROM cut),
c AS (SELECT record_id, ts, digest, etag, again, {_CANON} AS canon FROM parts),
hit AS (
  SELECT v.record_id, v.canon, v.ts, v.etag AS asked, r.record_id AS response_id, r.digest, r.etag, r.ts AS rts
  FROM c v LEFT JOIN c r ON NOT r.again AND r.canon = v.canon AND r.ts < v.ts WHERE v.again
  QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC NULLS LAST, r.record_id DESC) = 1),
s AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN asked IS NULL THEN 'unverified' WHEN asked = etag THEN 'resolved' ELSE 'mismatch' END AS status FROM hit)
SELECT record_id, canon, ts, response_id, CASE WHEN status IN ('resolved', 'unverified') THEN digest END AS digest, status,
       CASE WHEN status IN ('resolved', 'unverified') THEN 'cache-control: max-age=120' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10)
         || 'etag: ' || CASE WHEN status = 'unverified' THEN etag WHEN ts - rts >= {STEP} AND ts < 2 * {STEP} THEN 'W/' || asked ELSE asked END || chr(10) || 'server: origin' END AS headers
FROM s
"""
