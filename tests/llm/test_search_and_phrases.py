"""Phrase mining, ranked search and top-k search against brute force: nulls, empty and long texts, ties, repeats, hot groups, clashing columns, empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import balltree, collocations, lexical

UPPER = {c: c + 32 for c in range(65, 91)}
CLASH = "n long, rank int, score double, h long, k int, phrase string, row long, id long, class long, `my col` string, `a-b` int"
EXTRA = (1, 2, 0.5, 3, 4, "p", 5, 6, 7, "x", 8)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- op11 ---


def brute_phrases(docs, support, most=3, inside=50, top=2000):
    f, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        found = []
        for p, a in cand.items():
            score, cut = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= inside * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def phrase_docs():
    rng = random.Random(5)
    vocab = ["the", "of", "Old", "mill", "é", "ß x", "\x1c", "naïve", "a'b", "-", "\U0001f600", "zz"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " ", "\r\n", " "]) for _ in range(n))
    docs = [(text(rng.randint(0, 60)), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    docs += [("new york city hall", "en")] * 40 + [(None, "en"), ("", None), (" \t ", "fr"), (text(30_000), "en"), ("x" * 100_000, "de"), ("THE END the end The End", "es")]
    return docs + [("only once here", "it")] * 9 + [("ten times here", "pt")] * 10


@pytest.mark.parametrize(("support", "shards", "filter_most"), [(10, 3, 20_000_000), (10, 3, 0), (4, 5, 20_000_000), (1, 1, 20_000_000)])
def test_phrases_against_brute_force(spark, support, shards, filter_most):
    docs = phrase_docs()
    df = spark.createDataFrame([(t, la, *EXTRA) for t, la in docs], f"text string, lang string, {CLASH}").repartition(5)
    got = rows(collocations.collocations(df, support=support, shards=shards, filter_most=filter_most, top=50))
    assert got == brute_phrases(docs, support, top=50) and got


def test_phrases_of_other_widths_and_empty_tables(spark):
    docs = phrase_docs()
    df = spark.createDataFrame(docs, "text string, lang string")
    assert rows(collocations.collocations(df, support=6, most=5, inside=90, top=30)) == brute_phrases(docs, 6, 5, 90, 30)
    empty = collocations.collocations(df.limit(0))
    assert empty.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    assert empty.count() == 0


def test_phrases_beyond_packed_numbers():
    words = [f"w{i}" for i in range(3_000_000)]
    got = collocations.grams([" ".join(words).encode(), b"w1 w2 w3"], "en", 3)  # more words than three packed numbers hold
    ids, n, _ = got.widths[2]
    assert len(ids) == len(words) - 2 and n.max() == 2 and [got.vocab[i] for i in ids[n.argmax()]] == [b"w1", b"w2", b"w3"]


@pytest.mark.parametrize("shards", range(1, 12))
def test_local_support_loses_nothing(shards):
    assert shards * (collocations.local_support(10, shards) - 1) < 10


# --- op12 ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top=10):
    bags = [Counter(TERM.findall((t or "").translate(UPPER))) for _, t in docs]
    n = sum(1 for b in bags if b)
    total = sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(UPPER)))
        scored = []
        for (doc, _), b in zip(docs, bags, strict=True):
            m = 10 + 90 * sum(b.values()) * n // total if b else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, i, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def search_tables():
    rng = random.Random(9)
    vocab = ["alpha", "Beta", "gamma", "été", "x1", "delta", "漢字", "q", "common"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", ".", "-z", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 25))) for i in range(150)]
    docs += [(1000 + i, "Alpha beta! beta common") for i in range(60)] + [(900 - i, "beta alpha BETA; common") for i in range(30)]  # one class
    docs += [(5, "alpha"), (5, "alpha"), (5, "gamma gamma"), (None, "alpha alpha"), (None, None), (7, None), (8, ""), (9, " ... "), (2000, "common " * 20_000 + "alpha")]
    items = [(1, "alpha, ALPHA beta"), (2, "common"), (3, None), (4, ""), (5, "nowhere"), (1, "été gamma 漢字"), (None, "delta x1"), (6, text(200))]
    return docs, items


@pytest.mark.parametrize(("top", "block"), [(10, 2000), (3, 3)])
def test_search_against_brute_force(spark, top, block):
    docs, items = search_tables()
    d = spark.createDataFrame([(i, t, *EXTRA) for i, t in docs], f"doc_id long, text string, {CLASH}").repartition(7)
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, rank int")
    assert rows(lexical.search(d, q, top=top, block=block)) == brute_search(docs, items, top)


def test_classes_hold_what_is_identical(spark):
    docs, _ = search_tables()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = lexical.bags(d, [b"alpha", b"beta", b"common"]).withColumn("row", F.monotonically_increasing_id()).withColumn("m", F.col("n")).select("row", "id", "m", "bag")
    got = lexical.classes(b, 10).collect()
    members = [r for r in got if r["id"] is not None and 871 <= r["id"] <= 1059]
    assert sorted(r["id"] for r in members) == list(range(871, 881)) and len({r["class"] for r in members}) == 1  # of ninety the ten smallest
    assert all(r["place"] <= 10 for r in got)


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "alpha")], d.schema)
    asked = spark.createDataFrame([(1, "alpha")], q.schema)
    for a, b in ((d, q), (full, q), (d, asked)):
        out = lexical.search(a, b)
        assert out.count() == 0 and [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint"]


# --- op13 ---


def scaled(v):
    return [math.floor(x * 1024) if abs(x) < 2**60 else int(x) * 1024 for x in v]


def brute_nearest(table, k=10):
    ok = [(i, scaled(v)) for i, v in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is not None and i % 100 == 0:
            cut = lambda x: max(-(10**38) + 1, min(10**38 - 1, x))
            s = [(-cut(sum(x * y for x, y in zip(v, w, strict=True))), j is None, j or 0, j) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(v)]
            out += [(i, r, j, max(-(2**63), min(2**63 - 1, -x))) for r, (x, _, _, j) in enumerate(sorted(s, key=lambda t: t[:3])[:k], 1)]
    return sorted(out, key=str)


def vector_table(n=1500, dim=6):
    rng = np.random.default_rng(2)
    table = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(n)]
    table += [(10_000 + i, table[3][1]) for i in range(700)]  # a third is one vector
    table += [(100, table[5][1]), (100, table[5][1]), (None, table[7][1]), (None, None), (200, None), (300, [1.0, None] + [0.0] * (dim - 2)), (400, [float("nan")] * dim), (500, [float("inf")] * dim)]
    return table + [(20_000, [1.5, -0.0004]), (20_001, [2.0, 3.0]), (20_100, []), (20_101, []), (20_200, [0.0] * dim)]


@pytest.mark.parametrize(("shard_bytes", "block_bytes"), [(1 << 22, 1 << 22), (3_000, 500)])
def test_nearest_against_brute_force(spark, shard_bytes, block_bytes):
    table = vector_table()
    df = spark.createDataFrame([(i, v, *EXTRA) for i, v in table], f"vec_id long, embedding array<double>, {CLASH}").repartition(6)
    asks = F.col("id") % 100 == 0
    assert rows(balltree.nearest(df, asks, shard_bytes=shard_bytes, block_bytes=block_bytes)) == brute_nearest(table)


def test_nearest_beyond_doubles(spark):
    table = [(0, [1e300, 2.0]), (1, [3.0, 4.0]), (100, [2.0**50, 1.0]), (101, [2.0**50, 1.0 + 2**-10]), (102, [2.0**50, 1.0]), (103, [-(2.0**50), 0.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    assert rows(balltree.nearest(df, F.col("id") % 100 == 0)) == brute_nearest(table)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    none = spark.createDataFrame([(1, [1.0]), (2, [2.0])], df.schema)
    alone = spark.createDataFrame([(100, [1.0])], df.schema)
    for x in (df, none, alone):
        out = balltree.nearest(x, F.col("id") % 100 == 0)
        assert out.count() == 0 and [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint"]


def test_bounds_prune_and_hold():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 4000
    v = np.floor(np.concatenate([c + rng.normal(size=(200, 8)) * 50 for c in centres]))
    tree = balltree.BallTree.unpack(balltree.BallTree(v, 64).pack())
    q = v[::97]
    for node in range(len(tree.radius)):
        a, b = tree.span[node]
        assert (q @ v[tree.order[a:b]].T <= tree.bounds(q, np.array([node]))).all()
    seen = []
    plain, balltree._sums = balltree._sums, lambda a, b: seen.append(a.shape[0] * b.shape[0]) or (a @ b.T).astype(np.int64)
    try:
        best = balltree.Best(10, np.full(len(q), -np.inf))
        balltree.search_tree(tree, v, np.arange(len(v)), np.arange(len(v)), q, np.arange(len(v))[::97], best)
    finally:
        balltree._sums = plain
    want = np.sort((q @ v.T) - np.where(np.arange(len(v)) == np.arange(len(v))[::97][:, None], np.inf, 0), axis=1)[:, ::-1][:, :10]
    assert np.array_equal(np.array([[-s for s, _, _ in h] for h in best.held]), want)
    assert sum(seen) < 0.5 * len(q) * len(v)
