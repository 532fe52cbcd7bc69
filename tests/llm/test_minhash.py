"""Components against a comparison of all pairs."""

import random

import numpy as np

from cedarflow.llm import minhash as mh


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs, percent):
    sets = [(i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in docs if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=repr)


def corpus(rng, groups, size, per):
    docs = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(size)]
        for _ in range(per):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
            docs.append(" ".join(w))
    return docs


def run(spark, docs, percent):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in mh.group_near_duplicates(df, percent).collect()), key=repr)


def test_all_pairs(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = corpus(rng, 12, 90, 6) + corpus(rng, 1, 120, 150) + corpus(rng, 6, 7, 4) + corpus(rng, 3, 600, 5)
    texts += [f"{passage} own{i} " + " ".join(f"o{i}_{j}" for j in range(rng.choice([5, 12, 40]))) for i in range(90)]
    texts += ["A b c", "a  B\tc", "a b c d", None, "", " \n", "x " * 30000] + texts[:8]
    rng.shuffle(texts)
    docs = [(i * 3, t) for i, t in enumerate(texts)] + [(None, texts[0]), (6, texts[2])]
    assert run(spark, docs, 85) == brute(docs, 85)


def test_small_cases(spark):
    assert run(spark, [(1, None), (2, "a b c d e f")], 80) == brute([(1, None), (2, "a b c d e f")], 80)
    df = spark.createDataFrame([(1, "a b", "k", 1), (2, "A b", "k", 2), (3, None, None, 3)], "doc_id long, text string, n string, kept int")
    out = mh.keep_one_of_each(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]
    assert mh.group_near_duplicates(df.limit(0)).count() == 0


def test_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(200, 120)) for _ in range(90)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets[40:]] for a in sets[:40]])
    assert (mh.common_counts(sets[:40], sets[40:]) == want).all()
    members = [(k, k % 2, s) for k, s in enumerate(sets)]
    parts = mh.Parts()
    for i, j in ((0, 0), (0, 1), (1, 1)):
        for a, b in mh.block_edges([m for m in members if m[1] in (i, j)], i, j, 45):
            parts.join(a, b)
    full = mh.Parts()
    for a in range(90):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 45 * (len(sets[a]) + len(sets[b]) - both):
                full.join(a, b)
    assert [parts.root(k) for k in range(90)] == [full.root(k) for k in range(90)]
