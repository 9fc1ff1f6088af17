"""The near-dedup stage links texts by five-word similarity of 0.8, not by fingerprints alone."""

import random

from tidemark.llm import simhash


def jaccard(a, b):
    a, b = (set(simhash.shingles(t, 5)) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_links_are_checked(spark):
    rng = random.Random(3)
    texts = ["", " ", "one two", "One two", "one three"]
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(150)]
        for edits in (0, 0, 1, 2, 3, 3, 4, 5, 5, 6, 7, 8, 10):
            words = list(base)
            for at in rng.sample(range(150), edits):
                words[at] = f"x{rng.randrange(500)}"
            texts.append(" ".join(words))
    fp = [simhash.fingerprint(t) % (1 << 64) for t in texts]
    root, false = list(range(len(texts))), 0
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 8:
                if jaccard(texts[i], texts[j]) >= 0.8:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
                else:
                    false += 1
    assert false
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = dict(simhash.near_copies(docs, "key", radius=8).collect())
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > len({r["component_id"] for r in simhash.near_duplicates(docs, "key", radius=8).collect()})
