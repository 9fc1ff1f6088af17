"""Ranked lexical search by bag deduplication: documents with the same counts of the items' terms and the same length factor are scored once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialize

#: Items of a block, about: their terms and numbers are what tasks get.
ITEMS = 2_000

#: (class, item, term) triples that are added up at once.
ADDED = 4_000_000

#: A-Z is lowered; what ends a term becomes a blank: ASCII other than letters and digits (fixed rule).
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, A-Z lowered, repeats included."""
    return text.translate(_FOLD).split()


def bags(docs: DataFrame, vocabulary: list[bytes], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (terms of the whole text, long) and bag (pairs of a vocabulary number and its count as 32-bit integers, by number) of each row; null has no terms."""
    number = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            n, found = [], []
            for t in texts:
                ws = terms(t.as_py() or b"")
                n.append(len(ws))
                found.append(np.array(sorted((known[w], c) for w, c in Counter(ws).items() if w in known), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.binary())], ["id", "n", "bag"])

    return docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, bag binary")


def classes(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` members of each class by id (nulls last): class (its first member's row), id, m, bag, place.

    Rows with the same m and bag are one class: the hash deals them out, the bag itself and m tell them apart. Only `top` members can be among an
    item's first `top`, and each task keeps so many before anything is shuffled.
    """
    own = Window.partitionBy("h", "m", "bag").orderBy(F.col("id").asc_nulls_last(), "row")
    placed = rows.withColumn("h", F.xxhash64("bag", "m")).withColumn("place", F.row_number().over(own)).withColumn("class", F.first("row").over(own))
    return placed.filter(F.col("place") <= top).drop("h", "row")


def _scorer(of_item: list[np.ndarray], weight: np.ndarray, top: int):
    """For partitions of classes (class, id, m, bag): item, class, id and score of each item's best `top` in the partition."""
    item_of = np.concatenate([np.full(len(x), i) for i, x in enumerate(of_item)])
    term_of = np.concatenate(of_item)
    order = np.argsort(term_of, kind="stable")
    postings, n_items = item_of[order], len(of_item)
    first = np.searchsorted(term_of[order], np.arange(len(weight) + 1))
    width = np.diff(first)
    last_id = np.iinfo(np.int64).max

    def chunks(bag_list: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        cost = np.cumsum([int(width[b[:, 0]].sum()) + n_items for b in bag_list])
        a = 0
        while a < len(bag_list):
            b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + ADDED, side="right")))
            yield a, b
            a = b

    def best(items, scores, ids, names):
        at = np.lexsort((names, ids, -scores, items))
        items = items[at]
        start = np.searchsorted(items, items)
        at = at[np.arange(len(at)) - start < top]
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(4)]
        least = np.ones(n_items, np.int64)
        for batch in batches:
            names, m = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            ids = batch.column(1).fill_null(last_id).to_numpy()
            bag_list = [np.frombuffer(x.as_py(), np.int32).reshape(-1, 2) for x in batch.column(3)]
            for a, b in chunks(bag_list):
                pairs = np.concatenate(bag_list[a:b]).astype(np.int64)
                term, tf = pairs[:, 0], pairs[:, 1]
                owner = np.repeat(np.arange(b - a), [len(x) for x in bag_list[a:b]])
                gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[a:b][owner]))
                n = width[term]
                at = np.repeat(first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
                scores = np.bincount(np.repeat(owner, n) * n_items + postings[at], np.repeat(gain, n).astype(np.float64), (b - a) * n_items)  # whole numbers under 2^53
                scores = scores.astype(np.int64).reshape(b - a, n_items)
                row, item = np.nonzero(scores >= least)
                held = [np.concatenate(x) for x in zip(held, (item, scores[row, item], ids[a:b][row], names[a:b][row]), strict=True)]
                keep = best(*held)
                held = [x[keep] for x in held]
                full = np.flatnonzero(np.bincount(held[0], minlength=n_items) >= top)
                ends = np.searchsorted(held[0], full, side="right") - 1
                least[full] = held[1][ends]
        if len(held[0]):
            items, scores, ids, names = held
            yield pa.RecordBatch.from_arrays([pa.array(items.astype(np.int32)), pa.array(names), pa.array(ids), pa.array(scores)], ["item", "class", "id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = 10, block: int = ITEMS) -> DataFrame:
    """Each item's `top` best documents of all: item_id, rank (int, from 1), doc_id, score (longs); only scores above 0, equal ones by smaller doc_id.

    A score sums, over an item's distinct terms, w*((1000000000*tf) div (1000*tf+8*m)) with w = floor(1000*ln((2*N+2)/(2*df+1))) and
    m = 10+((90*n*N) div L): n a document's terms, N documents with a term, L their terms, df those holding the term, tf its occurrences.
    Null, empty and termless texts take no part. Rows count by themselves: a repeated document is ranked as often as it stands, a repeated
    item is answered as often; a null doc_id comes after all others of its score. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    asked = materialize(items.select(F.monotonically_increasing_id().alias("ask"), F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")), "items")
    blocks = max(1, -(-asked.count() // block))
    out = None
    for k in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == k).orderBy("ask").collect()  # about `block` items
        found = _searched(docs, mine, doc, text, top, spark)
        out = found if out is None else out.unionByName(found)
    return out


def _searched(docs: DataFrame, asked: list, doc: str, text: str, top: int, spark: SparkSession) -> DataFrame:
    each = [sorted(set(terms((r["text"] or "").encode()))) for r in asked]
    vocabulary = sorted(set().union(*each)) if each else []
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = materialize(bags(docs, vocabulary, doc, text).withColumn("row", F.monotonically_increasing_id()), "bags")
    total = rows.filter("n > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = total["n"], total["l"]
    rows = rows.filter(F.length("bag") > 0)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for x in batch.column(0):
                df[np.frombuffer(x.as_py(), np.int32)[::2]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], ["term", "df"])

    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select("bag").mapInArrow(holders, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term of the items
        df[r["term"]] = r["df"]
    weight = np.array([int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * int(d) + 1)))) for d in df], np.int64)
    rows = rows.withColumn("m", F.expr(f"10 + (90 * n * {n_docs}L) div {max(1, n_terms)}L"))
    members = materialize(classes(rows.select("row", "id", "m", "bag"), top), "members")
    of_item = [np.array([number[t] for t in x], np.int64) for x in each]
    scored = members.filter("place = 1").select("class", "id", "m", "bag")
    run = _scorer(of_item, weight, top) if vocabulary else lambda batches: iter(())
    scored = scored.mapInArrow(run, "item int, class long, id long, score long")
    first = Window.partitionBy("item").orderBy(F.desc("score"), "id", "class")
    ahead = materialize(scored.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= top).select("item", "class", "score"), "classes")
    # at most `top` classes an item, `top` members a class
    expanded = members.select("class", "id").join(F.broadcast(ahead), "class")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = expanded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(asked)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item; nulls, repeats and empties as `search` says."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
i AS (
  SELECT row_number() OVER () AS ask, item_id,
         unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
nl AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(len(t)), 0) AS BIGINT) AS l FROM d WHERE len(t) > 0),
p AS (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, CAST(count(*) AS BIGINT) AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY row, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nl.n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, nl),
s AS (
  SELECT i.ask, any_value(i.item_id) AS item_id, tf.row, any_value(tf.doc_id) AS doc_id,
         CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * tf.n * nl.n) // nl.l)))) AS BIGINT) AS score
  FROM i JOIN tf ON tf.term = i.term JOIN w ON w.term = i.term, nl
  GROUP BY i.ask, tf.row)
SELECT item_id, CAST(row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
