"""Exact top-k search by inner product: a ball tree for each shard, branch and bound in it, the current kth scores shared."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Components are scaled by this and rounded down to whole numbers.
SCALE = 1024

#: Bytes of vectors of a shard and of queries of a block, about, and vectors of a leaf at most.
SHARD_BYTES, BLOCK_BYTES, LEAF = 4 << 20, 4 << 20, 128

#: Vectors that place the others in shards are about this many, drawn by a hash; every vector is placed and searched.
SAMPLE = 4_096

#: One shard in so many is searched first; its kth scores then hold for the others.
FIRST = 16

#: Scores of more digits than this rank as if they were it.
MOST_SCORE = 10**38 - 1

#: Partial sums of products under this are exact in doubles.
EXACT = 1 << 52


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of each component, as doubles where all are exact, else as Python integers."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * SCALE)
    if np.abs(out).max(initial=0) < EXACT:
        return out
    exact = np.frompyfunc(lambda x: int(x) * SCALE if abs(x) >= EXACT else math.floor(x * SCALE), 1, 1)
    return exact(vectors)


def _near(vectors: np.ndarray) -> np.ndarray:
    """As doubles; Python integers, which only place vectors then, within bounds whose squares are doubles too."""
    if vectors.dtype != object:
        return vectors
    return np.frompyfunc(lambda x: float(max(-(10**100), min(10**100, x))), 1, 1)(vectors).astype(np.float64)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact: in doubles if no partial sum can pass 2**52, else in Python integers."""
    if a.dtype != object and b.dtype != object:
        if np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0) < EXACT:
            return (a @ b.T).astype(np.int64)
    plain = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return plain(a).dot(plain(b).T) if a.shape[1] else np.zeros((len(a), len(b)), np.int64)


class BallTree:
    """Vectors (rows, whole numbers) in leaves of up to LEAF, each node with its centre and radius; `order` is the place of each in the input.

    A query's inner product with what a node holds is at most q.c + |q| r.
    """

    FIELDS = ("order", "centre", "radius", "left", "right", "span")

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        near = _near(vectors)
        left, right, span, centre, radius = [], [], [], [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = near[self.order[a:b]]
            c = own.mean(axis=0)
            far = np.linalg.norm(own - c, axis=1)
            node = len(centre)
            centre.append(c)
            radius.append(far.max(initial=0.0))
            span.append((a, b))
            left.append(-1)
            right.append(-1)
            if parent >= 0:
                (right if side else left)[parent] = node
            if b - a <= leaf or not far.any():
                continue
            one = own[far.argmax()]
            other = own[np.linalg.norm(own - one, axis=1).argmax()]
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own @ (other - one), mid)]
            todo += [(a + mid, b, node, 1), (a, a + mid, node, 0)]
        self.centre, self.radius = np.array(centre).reshape(len(centre), vectors.shape[1]), np.array(radius)
        self.left, self.right, self.span = np.array(left), np.array(right), np.array(span)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpack(cls, packed: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(packed)) as found:
            for f in cls.FIELDS:
                setattr(tree, f, found[f])
        return tree

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of inner products, a little widened for rounding."""
        length, far = np.linalg.norm(queries, axis=1)[:, None], self.radius[nodes]
        return queries @ self.centre[nodes].T + length * far + length * (np.linalg.norm(self.centre[nodes], axis=1) + far) * 1e-9 + 1

    def leaves(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves that some query's bound reaches and the bounds (queries x leaves; -inf where a node above is beyond reach)."""
        level, alive = np.array([0]), np.ones((len(queries), 1), bool)
        ends, tops = [], []
        while len(level):
            top = np.where(alive, self.bounds(queries, level), -np.inf)
            alive = top >= least[:, None]
            some = alive.any(axis=0)
            level, top, alive = level[some], np.where(alive, top, -np.inf)[:, some], alive[:, some]
            end = self.left[level] < 0
            ends.append(level[end])
            tops.append(top[:, end])
            inner, alive = level[~end], alive[:, ~end]
            level = np.concatenate([self.left[inner], self.right[inner]])
            alive = np.concatenate([alive, alive], axis=1)
        return np.concatenate(ends), np.concatenate(tops, axis=1)


#: Sorts after every id.
_NO_ID = np.iinfo(np.int64).max


class Best:
    """Each query's best k so far as (-score, id, row); `least` is the current kth score, which a candidate has to reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.held: list[list[tuple]] = [[] for _ in least]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(scores) > 4 * self.k and scores.dtype != object:
            at = np.lexsort((rows, ids, -scores))[: self.k]
            scores, ids, rows = scores[at], ids[at], rows[at]
        own = sorted(self.held[query] + list(zip((-scores).tolist(), ids.tolist(), rows.tolist(), strict=True)))[: self.k]
        self.held[query] = own
        if len(own) == self.k:
            kth = -own[-1][0]
            self.least[query] = max(self.least[query], float(kth) if abs(kth) < EXACT else math.nextafter(float(max(-(10**300), min(10**300, kth))), -math.inf))


def search_tree(tree: BallTree, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, best: Best) -> None:
    """Branch and bound: each query visits its leaves by falling bound until the bound is below its current kth score.

    Queries that visit the same leaf at the same time are compared with it at once. own: the queries' rows, which are no candidates.
    Numbers beyond doubles have no bounds: all leaves are visited.
    """
    if vectors.dtype == object or queries.dtype == object:
        ends = np.flatnonzero(tree.left < 0)
        tops = np.full((len(queries), len(ends)), np.inf)
    else:
        ends, tops = tree.leaves(queries, best.least)
    turn = np.argsort(-tops, axis=1, kind="stable")
    alive = np.arange(len(queries))
    for step in range(len(ends)):
        at = turn[alive, step]
        near = (tops[alive, at] >= best.least[alive]) & (tops[alive, at] > -np.inf)
        alive, at = alive[near], at[near]
        for leaf in np.unique(at):
            here = alive[at == leaf]
            a, b = tree.span[ends[leaf]]
            member = tree.order[a:b]
            scores = _sums(queries[here], vectors[member])
            other = (rows[member] != own[here][:, None]) & (scores >= best.least[here][:, None])
            for q in np.flatnonzero(other.any(axis=1)):
                ok = other[q]
                best.add(int(here[q]), scores[q][ok], ids[member][ok], rows[member][ok])


def vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """row (its number), id, v (array of doubles) and dim: vectors that are null or hold a null, NaN or infinite component are left out."""
    v = F.col(vector).cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return table.filter(sound).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"))


def shards(rows: DataFrame, shard_bytes: int = SHARD_BYTES, sample: int = SAMPLE) -> DataFrame:
    """rows with dim, shard and piece: near vectors share a shard, and no (dim, shard, piece) is much larger than shard_bytes.

    Shards are the leaves of a ball tree over a sample; a shard that holds more than its due (one vector many times, say) is dealt to pieces by row.
    """
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()}  # one row a length
    n = sum(sizes.values())
    picked: dict[int, list] = {}
    for r in rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, sample / max(1, n))))).select("dim", "v").collect():
        picked.setdefault(r["dim"], []).append(r["v"])
    trees = {}
    for dim, own in picked.items():
        parts = max(1, sizes[dim] * max(1, dim) * 8 // shard_bytes)
        m = np.array(own, np.float64).reshape(len(own), dim)
        with np.errstate(over="ignore", invalid="ignore"):
            tree = BallTree(np.nan_to_num(m / max(1.0, np.abs(m).max(initial=0))), max(1, -(-len(own) // parts)))
        trees[dim] = (tree.centre[tree.left < 0], max(1.0, float(np.abs(m).max(initial=0))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, dims = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = np.zeros(len(v), np.int32)
            for dim in set(dims):
                if dim in trees:
                    at = [i for i, d in enumerate(dims) if d == dim]
                    centre, scale = trees[dim]
                    m = np.array([v[i] for i in at], np.float64).reshape(len(at), dim) / scale
                    with np.errstate(over="ignore", invalid="ignore"):
                        found[at] = ((centre**2).sum(axis=1) - 2 * m @ centre.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["row", "id", "v", "dim", "shard"])

    placed = materialize(rows.mapInArrow(place, "row long, id long, v array<double>, dim int, shard int"), "placed")
    due = F.greatest(F.lit(1), F.ceil(F.count("*") * F.greatest(F.col("dim"), F.lit(1)) * 8 / shard_bytes)).cast("int")
    pieces = placed.groupBy("dim", "shard").agg(due.alias("pieces"))
    dealt = placed.join(F.broadcast(pieces) if n < 10_000_000 else pieces, ["dim", "shard"])
    return dealt.withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces").cast("long")).cast("int")).drop("pieces")


def nearest(table: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k highest integer inner products of each query row with all other rows: query_id, rank (int, from 1), vec_id, score (longs).

    Components become floor(1024 * x), x as double. Queries: rows for which `asks` (a condition on id) holds; ties go to the smaller id, null ids
    last. Rows count by themselves: a repeated id is a candidate of its fellow, and each row that asks is answered. Vectors that are null
    or hold a null or non-finite component take no part; vectors of another length are no candidates. A score beyond 64 bits is
    ranked exactly up to 38 digits (more rank as 38 nines) and given as the nearest long. Empty tables give no rows; other columns are not read.
    """
    spark = table.sparkSession
    rows = materialize(vectors(table, key, vector), "vectors")
    asking = rows.filter(asks)
    need = asking.agg(F.coalesce(F.sum(F.greatest(F.col("dim"), F.lit(1)) * 8), F.lit(0)).alias("b")).first()["b"]
    dealt = shards(rows, shard_bytes)

    def grow(shard: pd.DataFrame) -> pd.DataFrame:
        raw = np.array(shard["v"].tolist(), np.float64).reshape(len(shard), shard["dim"].iloc[0])
        ids = shard["id"].astype("Int64").fillna(_NO_ID).to_numpy(np.int64)
        return pd.DataFrame({"dim": [raw.shape[1]], "ids": [ids.tobytes()], "numbers": [shard["row"].to_numpy(np.int64).tobytes()], "raw": [raw.tobytes()], "tree": [BallTree(whole(raw)).pack()]})

    trees = materialize(shards(rows, shard_bytes).groupBy("dim", "shard", "piece").applyInPandas(grow, "dim int, ids binary, numbers binary, raw binary, tree binary"), "trees")
    blocks = max(1, -(-need // block_bytes))
    found = []
    for b in range(blocks if need else 0):
        mine = asking.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()  # about block_bytes
        if mine.num_rows:
            found.append(_block(trees, mine, k))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _block(trees: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """The answers of one block of queries: first from some shards, whose kth scores then hold for all others."""
    spark = trees.sparkSession
    dims = asked["dim"].to_numpy()
    queries = {}
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        raw = np.array(asked["v"].take(at).to_pylist(), np.float64).reshape(len(at), dim)
        queries[int(dim)] = (whole(raw), asked["row"].to_numpy()[at])
    shared = spark.sparkContext.broadcast(queries)

    def wave(part: DataFrame, least: dict[int, float]) -> DataFrame:
        known = spark.sparkContext.broadcast(least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {d: Best(k, np.array([known.value.get(r, -np.inf) for r in own.tolist()])) for d, (_, own) in shared.value.items()}
            for batch in batches:
                for shard in batch.to_pylist():
                    dim = shard["dim"]
                    if dim in best:
                        m = whole(np.frombuffer(shard["raw"]).reshape(-1, dim) if dim else np.zeros((len(shard["ids"]) // 8, 0)))
                        ids, numbers = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["numbers"], np.int64)
                        search_tree(BallTree.unpack(shard["tree"]), m, ids, numbers, *shared.value[dim], best[dim])
            for dim, b in best.items():
                own = shared.value[dim][1].tolist()
                out = [(own[i], str(max(-MOST_SCORE, min(MOST_SCORE, -score))), vec, row) for i, held in enumerate(b.held) for score, vec, row in held]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["ask", "score", "id", "row"])

        return part.mapInArrow(run, "ask long, score string, id long, row long").select("ask", F.col("score").cast("decimal(38,0)").alias("exact"), "score", "id", "row")

    order = Window.partitionBy("ask").orderBy(F.desc("exact"), "id", "row")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ahead = F.pmod(F.xxhash64("numbers"), F.lit(FIRST)) == 0
    first = materialize(ranked(wave(trees.filter(ahead), {})), "first")
    kth = {r["ask"]: math.nextafter(float(r["exact"]), -math.inf) for r in first.filter(F.col("rank") == k).select("ask", "exact").collect()}  # one row a query of the block
    rest = wave(trees.filter(~ahead), kth)
    both = ranked(first.drop("rank").unionByName(rest))
    names = spark.createDataFrame(asked.select(["row", "id"]).rename_columns(["ask", "query_id"]).to_pandas())
    low, high = -(1 << 63), _NO_ID
    score = F.least(F.greatest(F.col("exact"), F.lit(low).cast("decimal(38,0)")), F.lit(high).cast("decimal(38,0)")).cast("long")
    return both.join(F.broadcast(names), "ask").select("query_id", "rank", F.when(F.col("id") != _NO_ID, F.col("id")).alias("vec_id"), score.alias("score"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others; nulls, repeats and ties as `nearest` says."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.row <> q.row AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) <= 10
"""
