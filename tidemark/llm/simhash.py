"""SimHash near-dedup: vantage-point trees shard the fingerprints, exact pairs come from shards that a ball reaches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed, materialize
from .components import components

#: op1's shingles are of 3 words; the tree serves any width.
SHINGLE = 3
RADIUS = 2
SEED = 42

#: The tree is fitted on about this many distinct fingerprints, drawn by their hash.
SAMPLE = 20_000

#: Fingerprints that a shard owns, about, and that it is compared with at once; at least LEAST_DEPTH levels are made so that tasks are many.
SHARD_ROWS = 16_384
GUEST_ROWS = 1 << 18
LEAST_DEPTH = 5


def shingles(text: str | None, width: int) -> list[int]:
    """XXH64 of each run of `width` words, A-Z lowered; of the whole sequence if it is shorter; none without words."""
    ws = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(ws) < width:
        return [digest(b" ".join(ws), SEED)] if ws else []
    return [digest(b" ".join(s), SEED) for s in zip(*(ws[k:] for k in range(width)), strict=False)]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash (signed) of a text's word shingles: a bit is 1 if it is set in over half of their XXH64.

    A-Z is lowered; words end at blanks. Under `width` words: the whole sequence is the one shingle; none: 0.
    """
    h = shingles(text, width)
    if not h:
        return 0
    bits = np.zeros(64, np.int64)
    for a in range(0, len(h), 65_536):
        part = np.array(h[a : a + 65_536], np.uint64).view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """key and fp (long). Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py(), width) for x in batch.column(1)], pa.int64())], ["key", "fp"])

    schema = keyed(docs.schema[key].dataType, "fp long")
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class VpTree:
    """Inner nodes in heap order: node i has children 2i+1 (within `cut[i]` of `point[i]`) and 2i+2. Leaves are the shards."""

    depth: int
    point: np.ndarray
    cut: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> VpTree:
        n = (1 << depth) - 1
        point, cut = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        todo = [(0, np.sort(sample))]
        while todo:
            i, own = todo.pop()
            if i >= n:
                continue
            point[i], cut[i] = _vantage(own) if len(own) else (np.uint64(i), 32)
            near = distance(own, point[i]) <= cut[i]
            todo += [(2 * i + 1, own[near]), (2 * i + 2, own[~near])]
        return cls(depth, point, cut)

    def route(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (index into fp, shard, own): the shards that may own a fingerprint within radius of each, its own among them.

        By the triangle inequality a partner of q within radius that is in the inner part lies at d(q) - radius or more
        from the vantage point, and one in the outer part at d(q) + radius or less.
        """
        at, node, own = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
        for _ in range(self.depth):
            d = distance(fp[at], self.point[node]).astype(np.int64)
            cut = self.cut[node]
            inner, outer = d - radius <= cut, d + radius > cut
            home = d <= cut
            at = np.concatenate([at[inner], at[outer]])
            own = np.concatenate([(own & home)[inner], (own & ~home)[outer]])
            node = np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
        return at, node - ((1 << self.depth) - 1), own


def _vantage(own: np.ndarray) -> tuple[np.uint64, int]:
    """Of a few points, the one whose distances spread most, and the cut that halves them best."""
    best = None
    few = own[:: max(1, len(own) // 256)]
    for p in own[np.linspace(0, len(own) - 1, min(8, len(own))).astype(int)]:
        spread = float(distance(few, p).std())
        if best is None or spread > best[0]:
            best = (spread, p)
    d = np.sort(distance(own, best[1]).astype(np.int64))
    cuts = np.unique(d)
    halves = np.abs(np.searchsorted(d, cuts, side="right") - len(d) / 2)
    return best[1], int(cuts[halves.argmin()])


class Groups:
    """Disjoint sets of 0..n-1 under unions of whole arrays of pairs; a root is the smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def link_within(own: np.ndarray, guests: np.ndarray, fp: np.ndarray, radius: int, groups: Groups, brute: int = 1 << 21) -> None:
    """Join in groups all pairs (own, guest) of fp within radius; own and guests are indexes into fp, own among guests.

    A vantage-point tree is walked over the shard: its parts are cut in two until the pairs left are few enough to compare.
    """
    todo = [(own, guests)]
    while todo:
        own, guests = todo.pop()
        if not len(own) or not len(guests):
            continue
        if len(own) > 48 and len(own) * len(guests) > 4096:
            point, cut = _vantage(np.sort(fp[own]))
            d = distance(fp[own], point)
            near = d <= cut
            g = distance(fp[guests], point).astype(np.int64)
            inner, outer = guests[g - radius <= cut], guests[g + radius > cut]
            if 0 < near.sum() < len(own) and len(inner) + len(outer) < 1.6 * len(guests):  # else the bounds prune too little
                todo += [(own[near], inner), (own[~near], outer)]
                continue
        step = max(1, brute // len(guests))
        for a in range(0, len(own), step):
            part = own[a : a + step]
            i, j = np.nonzero(distance(fp[part][:, None], fp[guests][None, :]) <= radius)
            groups.union(part[i], guests[j])


def links(fps: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, guest_rows: int = GUEST_ROWS) -> DataFrame:
    """Edges (a, b) that join all fingerprints (column fp, distinct) within radius, a spanning set for each shard and block.

    The tree is fitted on the sample, but every fingerprint is routed and compared: the result is exact. What reaches a shard is counted first and
    then dealt to as many blocks as it fills, by a hash, each with all that the shard owns: a group holds about shard_rows + guest_rows fingerprints
    at any size, and what a shard owns is repeated only for guests that its balls let in. The counts are 8 bytes a shard (n / shard_rows shards).
    """
    n = fps.count()
    draw = F.pmod(F.xxhash64("fp", F.lit("vp")), F.lit(1 << 40)) / float(1 << 40)
    rows = fps.filter(draw < min(1.0, sample / max(1, n))).select("fp").toArrow()["fp"]
    depth = max(LEAST_DEPTH, int(np.ceil(np.log2(max(1.0, n / shard_rows)))))
    tree = VpTree.fit(rows.to_numpy().view(np.uint64), depth)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guests = np.zeros(1 << tree.depth, np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(fp), 50_000):
                guests += np.bincount(tree.route(fp[a : a + 50_000], radius)[1], minlength=len(guests))
        at = np.flatnonzero(guests)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(guests[at])], ["shard", "n"])

    filled = np.ones(1 << depth, np.int64)
    if n > guest_rows:  # else no shard can have more than one block
        counts = fps.select("fp").mapInArrow(reached, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).toArrow()
        filled[counts["shard"].to_numpy()] = -(-counts["n"].to_numpy() // guest_rows)
    blocks = fps.sparkSession.sparkContext.broadcast(filled)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(fp), 50_000):
                part = fp[a : a + 50_000]
                at, shard, own = tree.route(part, radius)
                block = (part[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % blocks.value[shard].astype(np.uint64)
                mine = np.flatnonzero(own)
                times = blocks.value[shard[mine]]
                each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)  # 0 to times - 1 for each of mine
                shard = np.concatenate([shard, np.repeat(shard[mine], times)])
                block = np.concatenate([block, each]).astype(np.int32)
                value = np.concatenate([part[at], np.repeat(part[at[mine]], times)])
                own = np.concatenate([np.zeros(len(at), bool), np.ones(len(each), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(block), pa.array(value.view(np.int64)), pa.array(own)], ["shard", "block", "fp", "own"])

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        fp, place = np.unique(shard["fp"].to_numpy().view(np.uint64), return_inverse=True)
        mine = shard["own"].to_numpy()
        groups = Groups(len(fp))
        link_within(place[mine], place[~mine], fp, radius, groups)
        root = groups.roots(np.arange(len(fp)))
        linked = root != np.arange(len(fp))
        return pd.DataFrame({"a": fp[linked].view(np.int64), "b": fp[root[linked]].view(np.int64)})

    routed = fps.select("fp").mapInArrow(route, "shard int, block int, fp long, own boolean")
    return routed.groupBy("shard", "block").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: key, fp (long), component_id (the smallest key of those that links reach).

    Equal fingerprints are linked (distance 0), those of wordless texts too. A null key takes part but is never the smallest;
    a component of null keys alone has a null id. Works on distinct fingerprints: thousands of copies are one row.
    """
    each = materialize(fingerprints(docs, key, text, width), "fingerprints")
    fps = materialize(each.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    stars = components(links(fps, radius)).withColumnRenamed("node", "fp")
    rooted = materialize(fps.join(stars, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    ids = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component_ids")
    by_fp = materialize(rooted.join(ids, "root").select("fp", "component_id"), "components")
    return each.join(by_fp, "fp").select(key, "fp", "component_id")


#: Texts and shingles of a block.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 500_000


def near_copies(docs: DataFrame, key: str, text: str = "text", radius: int = RADIUS, width: int = 5, least: float = 0.8, fingerprint_width: int = SHINGLE) -> DataFrame:
    """key and component_id, the smallest key of those that links reach. Keys are longs, distinct and not null.

    Texts are linked if they are equal, or if their fingerprints (of fingerprint_width words) lie within radius and the Jaccard similarity of
    their sets of `width`-word shingles is `least` or more. Null and empty texts are alike. Fingerprint links give groups outside of which there
    is no link. In a group, texts like its most central one are linked to that; each that is not is compared with all of its group, block by
    block, where a pair of blocks gives a spanning set of its links, not all pairs. So no link is missed, and no task holds a group.
    """
    each = docs.select(F.col(key).alias("key"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("sha"))
    each = materialize(each.join(fingerprints(docs, key, text, fingerprint_width).select(F.col(key).alias("key"), "fp").hint("merge"), "key"), "fingerprints")
    texts = materialize(each.groupBy("sha").agg(F.min("key").alias("node"), F.min("fp").alias("fp")), "texts")
    loose = components(links(materialize(texts.select("fp").distinct(), "distinct"), radius)).withColumnRenamed("node", "fp")
    placed = materialize(texts.join(loose.hint("merge"), "fp", "left").select("node", "fp", F.coalesce("root", "fp").alias("area")), "placed")
    shared = placed.groupBy("area").agg(F.count("*").alias("n")).filter("n > 1").select("area")
    placed = placed.join(shared.hint("merge"), "area")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.array(shingles(x.as_py(), width), np.uint64)).view(np.int64) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["node", "fp", "area", "shingles"])

    full = placed.join(docs.select(F.col(key).alias("node"), F.col(text).alias("text")).hint("merge"), "node").select("node", "fp", "area", "text")
    full = materialize(full.mapInArrow(sets, "node long, fp long, area long, shingles array<long>"), "shingles")
    head = full.join(_central(full).hint("merge"), ["node", "area"]).select("area", F.col("node").alias("b"), F.col("fp").alias("fp_b"), F.col("shingles").alias("shingles_b"))
    like = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= radius) & (_jaccard("shingles", "shingles_b") >= least)
    found = materialize(full.join(head.hint("merge"), "area").filter((F.col("node") == F.col("b")) | like).select("node", "b"), "like_central")
    rest = full.select("node").join(found.hint("merge"), "node", "left_anti")
    edges = found.filter("node <> b").select(F.col("node").alias("a"), "b").unionByName(_compared(full, rest, radius, least))
    stars = components(edges)
    ids = texts.join(stars.hint("merge"), "node", "left").select("sha", F.coalesce("root", "node").alias("component_id"))
    return each.join(ids.hint("merge"), "sha").select(F.col("key").alias(key), "component_id")


def _central(rows: DataFrame) -> DataFrame:
    """area and node: of each area the one whose fingerprint is nearest to the area's bitwise majority, the smallest of several."""
    bits = rows.groupBy("area").agg(F.count("*").alias("n"), *[F.sum(F.expr(f"getbit(fp, {k})").cast("long")).alias(f"b{k}") for k in range(64)])
    most = F.lit(0).cast("long")
    for k in range(64):
        most = most.bitwiseOR(F.when(F.col(f"b{k}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(0))
    far = rows.select("area", "node", "fp").join(bits.select("area", most.alias("most")).hint("merge"), "area")
    return far.groupBy("area").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("most"))), "node")).alias("x")).select("area", F.col("x.node").alias("node"))


def _compared(full: DataFrame, rest: DataFrame, radius: int, least: float) -> DataFrame:
    """Edges (a, b) that join each of the nodes in `rest` to all of its area that are like it: a spanning set for each pair of blocks."""
    size = lambda df: df.groupBy("area").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    asks = materialize(full.join(rest.hint("merge"), "node"), "asking")
    n_asks, n_all = size(asks).withColumnRenamed("blocks", "ask_blocks"), size(full).withColumnRenamed("blocks", "all_blocks")
    blocks = materialize(n_asks.join(n_all.hint("merge"), "area"), "blocks")
    deal = lambda of: F.pmod(F.xxhash64("node"), F.col(of).cast("long")).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    cols = ["area", "node", "fp", "shingles"]
    x = asks.join(blocks.hint("merge"), "area").select(*cols, deal("ask_blocks").alias("i"), every("all_blocks").alias("j"))
    y = full.join(blocks.hint("merge"), "area").select(*cols, deal("all_blocks").alias("j"), every("ask_blocks").alias("i"))

    def link(asking: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        node = np.concatenate([asking["node"].to_numpy(np.int64), others["node"].to_numpy(np.int64)])
        names, place = np.unique(node, return_inverse=True)
        groups = Groups(len(names))
        if len(asking) and len(others):
            sets = [np.asarray(s, np.int64) for s in others["shingles"]]
            sizes, fp = np.array([len(s) for s in sets]), others["fp"].to_numpy(np.int64)
            value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            for k, (own, mine) in enumerate(zip(asking["fp"].to_numpy(np.int64), asking["shingles"], strict=True)):
                mine = np.asarray(mine, np.int64)
                first, last = np.searchsorted(value, mine), np.searchsorted(value, mine, side="right")
                n = last - first
                at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
                both = np.bincount(owner[at], minlength=len(sets))
                of = sizes + len(mine) - both
                alike = np.where(of == 0, 1.0, both / np.maximum(of, 1)) >= least
                alike &= np.bitwise_count((fp ^ own).view(np.uint64)) <= radius
                hit = place[len(asking) + np.flatnonzero(alike)]
                groups.union(np.full(len(hit), place[k]), hit)
        root = groups.roots(np.arange(len(names)))
        linked = root != np.arange(len(names))
        return pd.DataFrame({"a": names[linked], "b": names[root[linked]]})

    return x.groupBy("area", "i", "j").cogroup(y.groupBy("area", "i", "j")).applyInPandas(link, "a long, b long")


def _jaccard(a: str, b: str) -> Column:
    """Of two arrays of distinct longs; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    of = F.size(a) + F.size(b) - both
    return F.when(of == 0, 1.0).otherwise(both / of)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents: a row each, repeats included; wordless texts are linked, null ids are never a component's name."""
    out = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
