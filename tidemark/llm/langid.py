"""Language ID by prediction by partial matching: byte context trees of each language give exact code lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed, slices

#: Longest context in bytes. A window is a context and the byte that follows it.
ORDER = 3

#: Bound of the sample that the trees are learnt from: about this many documents of each language.
SAMPLE = 2_000

#: Mean bits a byte over which a text is not prose of any learnt language.
MOST_BITS = 6.5

UNKNOWN = "und"
_PAD = b"\n" * ORDER
_SLOTS = 21


def held_out(key: Column, folds: int, fold: int) -> Column:
    """crc32 of the key as text, mod folds, is fold. Null keys are never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (ASCII lowered, led by ORDER line breaks), and each text's first and last-plus-one window."""
    data = [_PAD + (t or "").encode().lower() for t in texts]
    ends = np.cumsum([len(x) for x in data])
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    w = np.zeros(max(0, len(b) - ORDER), np.uint32)
    for k in range(ORDER + 1):
        w |= b[k : len(b) - ORDER + k] << np.uint32(8 * (ORDER - k))
    return w, np.concatenate([[0], ends[:-1]]).astype(np.int64), (ends - ORDER).astype(np.int64)


@dataclass
class Tree:
    """Counts under frozen statistics. Of each order k: windows of k+1 bytes and contexts of k bytes, by language."""

    langs: list[str]
    keys: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]

    @classmethod
    def fit(cls, langs: list[str], lang: np.ndarray, window: np.ndarray, n: np.ndarray) -> Tree:
        """From counts of whole windows; shorter contexts' counts are their sums."""
        keys, counts, contexts, totals, distinct = [], [], [], [], []
        for k in range(ORDER + 1):
            key, at = np.unique(window & np.uint32((1 << 8 * (k + 1)) - 1 if k < 3 else 0xFFFFFFFF), return_inverse=True)
            c = np.zeros((len(key), len(langs)))
            np.add.at(c, (at, lang), n)
            ctx, where = np.unique(key >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(ctx), len(langs))), np.zeros((len(ctx), len(langs)))
            np.add.at(total, where, c)
            np.add.at(kinds, where, c > 0)
            keys.append(key)
            counts.append(c)
            contexts.append(ctx)
            totals.append(total)
            distinct.append(kinds)
        return cls(langs, keys, counts, contexts, totals, distinct)

    def bits(self, w: np.ndarray) -> np.ndarray:
        """Code length of each window's last byte in each language.

        The longest context that was seen predicts: a byte seen there has count / (total + distinct), else the escape,
        distinct / (total + distinct), leads to the context one byte shorter; below the empty context all 256 bytes are
        equal. Contexts never seen are passed over at no cost. There is no exclusion of bytes already refused.
        """
        out = np.zeros((len(w), len(self.langs)))
        open_ = np.ones(out.shape, bool)
        for k in range(ORDER, -1, -1):
            key = w & np.uint32((1 << 8 * (k + 1)) - 1 if k < 3 else 0xFFFFFFFF)
            c = _rows(self.keys[k], self.counts[k], key)
            ctx = key >> np.uint32(8)
            n, q = _rows(self.contexts[k], self.totals[k], ctx), _rows(self.contexts[k], self.distinct[k], ctx)
            hit, escape = open_ & (c > 0), open_ & (c == 0) & (n > 0)
            out[hit] += np.log2((n[hit] + q[hit]) / c[hit])
            out[escape] += np.log2((n[escape] + q[escape]) / q[escape])
            open_ &= ~hit
        out[open_] += 8
        return out


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values of the wanted keys, 0 where a key is absent."""
    if not len(keys):
        return np.zeros((len(wanted), values.shape[1]))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], 0)


class Scorer:
    """A tree with the code lengths of its own windows ready; others are worked out as they come."""

    def __init__(self, tree: Tree):
        self.tree = tree
        known = tree.keys[ORDER]
        self.ready = np.ascontiguousarray(tree.bits(known).T)
        self.known = known
        self.slot = np.full(1 << _SLOTS, -1, np.int32)
        often = np.argsort(tree.counts[ORDER].sum(axis=1), kind="stable")  # the most frequent window keeps a shared slot
        self.slot[self._place(known[often])] = often

    @staticmethod
    def _place(w: np.ndarray) -> np.ndarray:
        return (w * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)

    def text_bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each whole text in each language."""
        w, first, last = windows(texts)
        if not len(w) or not len(self.known):
            n = np.array([len(x) for x in texts])[:, None] if len(texts) else np.zeros((0, 1))
            return np.zeros((len(texts), len(self.tree.langs))) + (8.0 * n if not len(self.known) else 0)
        at = self.slot[self._place(w)]
        rare = np.flatnonzero((at < 0) | (self.known[at] != w))
        kinds, back = np.unique(w[rare], return_inverse=True)
        more = self.tree.bits(kinds)
        edges = np.minimum(np.stack([first, last], axis=1).ravel(), len(w) - 1)
        out = np.empty((len(texts), len(self.tree.langs)))
        for k in range(len(self.tree.langs)):
            each = self.ready[k][at]
            each[rare] = more[back, k]
            sums = np.add.reduceat(each, edges)[::2]
            if last[-1] == len(w) and last[-1] > first[-1]:  # the last text ends with the array
                sums[-1] = each[first[-1] :].sum()
            out[:, k] = np.where(last > first, sums, 0)
        return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Tree:
    """The trees of all languages in (key, text, lang) rows, from about `sample` rows of each, chosen by the key's hash."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("key").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Tree.fit([], np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for a, n in sizes.items() for x in (a, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64("key", F.lit("ppm")), F.lit(1 << 40)) / float(1 << 40)
    chosen = rows.filter(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(names)):
                w, first, last = windows([t for n, t in zip(names, texts, strict=True) if n == lang])
                keep = np.zeros(len(w) + 1, np.int8)
                np.add.at(keep, first, 1)
                np.add.at(keep, last, -1)
                kinds, n = np.unique(w[np.cumsum(keep)[:-1] > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "w", "n"])

    got = chosen.mapInArrow(run, "lang string, w long, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")).toArrow()
    code = {a: k for k, a in enumerate(langs)}
    lang = np.array([code[x] for x in got["lang"].to_pylist()], np.int64)
    return Tree.fit(langs, lang, got["w"].to_numpy().astype(np.uint32), got["n"].to_numpy().astype(float))


def predict(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (the share of the best language, all equally likely before) and bits_per_byte.

    `und`, score 0 and null bits for a null text or one without a letter, and for all texts if nothing was learnt.
    Ties go to the language that sorts first.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs = np.array([*scorer.tree.langs, UNKNOWN], dtype=object)
        for batch in batches:
            texts, letter = [x or "" for x in batch.column(1).to_pylist()], np.array(batch.column(2).to_pylist(), bool)
            for a, b in slices(texts, 1_000_000):
                none = ~letter[a:b] | (len(scorer.tree.langs) == 0)
                if len(scorer.tree.langs):
                    bits = scorer.text_bits(texts[a:b])
                    best = bits.argmin(axis=1)
                    least = bits.min(axis=1)
                    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    size = np.array([max(1, len(x.encode())) for x in texts[a:b]])
                    best, score, mean = np.where(none, len(langs) - 1, best), np.where(none, 0.0, score), least / size
                else:
                    best, score, mean = np.zeros(b - a, int), np.zeros(b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(langs[best].tolist(), pa.string()), pa.array(score), pa.array(mean, mask=none)],
                    ["key", "lang_pred", "score", "bits_per_byte"],
                )

    schema = keyed(docs.schema[key].dataType, "lang_pred string, score double, bits_per_byte double")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict() for all documents: a row each, repeats included. Null texts and texts without a letter are `und`; a null id is never held out; rows
    with a null lang teach nothing; copies are judged alike; if nothing teaches, all are `und`. Other columns are not read."""
    docs = documents(spark, sf_dir)
    train = docs.filter(~held_out(F.col("doc_id"), 4, 2)).select(F.col("doc_id").alias("key"), "text", "lang")
    out = predict(docs, learn(train))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")
