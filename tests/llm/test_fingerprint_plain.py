"""Fingerprints sampled anew a term at a time, and odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np

from cedarflow.llm import fingerprint as fp
from cedarflow.llm.shingles import shingle_hashes

WORD = 1 << 64


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % WORD
    return x ^ (x >> 31)


def plain(text, samples=fp.SAMPLES):
    """Consistent weighted sampling as it is written down, without batches."""
    weights = Counter(next(shingle_hashes([text])).tolist())
    multipliers, lnc, r, beta, _ = fp.variates(samples)
    out = []
    for m in multipliers.tolist():
        best = None
        for term, s in weights.items():
            k = m * term % WORD >> 48
            t = math.floor(np.log(s) / r[k] + beta[k])
            found = (np.float32(lnc[k] - r[k] * (t - beta[k]) - r[k]), term, t)
            best = found if best is None or found < best else best
        out.append(mixed((best[1] + best[2] * 0x9E3779B97F4A7C15) % WORD) >> 48 if best else 0)
    return "".join(f"{x:04x}" for x in out)


def test_same_as_plain_sampler(spark):
    rng = random.Random(11)
    texts = [None, "", " \n", "one", "one two", "a a a a a a a", "b " * 3000, " ".join(f"w{i}" for i in range(2500)), "é ü 🙂 ß x y"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 400))) for _ in range(25)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").orderBy("doc_id").collect()[::20]]
    signed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint(signed).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), i


def test_clashing_columns_repeated_rows_and_very_long_texts(spark):
    long = " ".join(f"v{i % 5000}" for i in range(100000))
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, None), (None, None), (None, "x"), (5, long), (4, long)]
    docs = spark.createDataFrame([(d, t, 1, "g", "f") for d, t in rows], "doc_id long, text string, bucket int, ghost string, fingerprint string")
    out = fp.fingerprint_report(docs).collect()
    assert len(out) == len(rows)
    by = {(r["doc_id"], r["n_chars"]): r for r in out}
    assert by[(5, len(long))]["fingerprint"] == by[(4, len(long))]["fingerprint"] == plain(long, fp.SAMPLES)
    assert by[(5, len(long))]["near_next"] == 1.0 and by[(3, 11)]["fingerprint"] == plain("a b c d e f")
    kept = fp.fingerprint(docs)
    assert kept.columns == docs.columns and {r["bucket"] for r in kept.collect()} == {1}


def test_rows_of_one_id_are_dealt_to_several_buckets(spark):
    rng = random.Random(4)
    rows = [(None, f"{rng.random()} none {i}") for i in range(300)] + [(7, f"{rng.random()} seven {i}") for i in range(300)]
    rows += [(i, f"text {i}") for i in range(300)] + [(7, None), (7, ""), (None, None), (None, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = fp.neighbours(docs)
    sizes = Counter((r["doc_id"], r["bucket"]) for r in dealt.filter("not ghost").select("doc_id", "bucket").collect())
    total = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for c in (None, 7):
        mine = [n for (d, _), n in sizes.items() if d == c]
        assert sum(mine) >= 302 and max(mine) < 4 * len(rows) / total
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        want.append((str(d), len(t), hashlib.sha256(fp.edited(t, after).encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in fp.fingerprint_report(docs).collect()]
    assert sorted(got) == sorted(want)
