"""Pairs at the threshold, long lists, and no tables left over."""

import os
import random

from cedarflow.llm import minhash as mh
from tests.llm.test_minhash import brute, run, shingles


def at_threshold(rng, size, percent):
    """Two texts whose sets are just alike enough."""
    while True:
        a = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        b = list(a)
        k = 0
        while 100 * len(shingles(" ".join(a)) & shingles(" ".join(b))) >= percent * len(shingles(" ".join(a)) | shingles(" ".join(b))):
            last, k = list(b), k + 1
            b[-k if k <= size // 4 else rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        if k > 1:
            return " ".join(a), " ".join(last)


def test_planted_pairs_at_the_threshold_are_all_found(spark):
    rng = random.Random(11)
    docs = []
    for size in (30, 60, 100, 300, 800):
        for _ in range(120):
            for text in at_threshold(rng, size, 85):
                docs.append((len(docs), text))
    got = {r[0]: r[2] for r in run(spark, docs, 85)}
    assert all(got[i] == i - i % 2 for i in range(len(docs)))


def test_long_lists_of_several_components(spark):
    """A passage that all share, too long to be passed over; some are alike, in
    chains too, and some are not."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(160)]
    texts = []
    for g in range(30):
        own = [f"g{g}_{i}" for i in range(24)]
        for k in range(5):
            own = own[:-2] + [f"g{g}_{k}_{i}" for i in range(2)] if k else own
            texts.append(" ".join(passage + own))
    texts += [" ".join(passage[:150] + [f"n{i}_{j}" for j in range(60)]) for i in range(40)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    for percent in (85, 80):
        assert run(spark, docs, percent) == brute(docs, percent)


def test_tables_are_deleted(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    assert len(run(spark, [(i, f"a b c d e {i // 2}") for i in range(20)], 80)) == 20
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} <= {"sketches", "classes", "edges"}
