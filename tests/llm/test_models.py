"""Language ID by held-out accuracy, fingerprints by similarity."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from cedarflow.llm import fingerprint as fp
from cedarflow.llm import langid
from cedarflow.llm.shingles import shingle_hashes

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.langid_report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 150 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out) and sum(r["rejected"] for r in out) <= 0.02 * len(out)


def test_language_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(300)
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "12 34 !", "en"), (-3, "", None), (None, "the and of that", None), (-4, "the and " * 200000, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.langid_report(docs.unionByName(odd)).collect()}
    assert [got[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3 and got[-1]["score"] == 0
    assert got[None]["lang_pred"] == "en" and got[-4]["lang_pred"] == "en" and got[None]["held_out"] is False
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.langid_report(none).collect()} == {"und"}
    assert langid.langid_report(odd.limit(0)).count() == 0
    kept = langid.keep_identified(docs.unionByName(odd).withColumn("score", F.lit("s")))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and {r["score"] for r in kept.collect()} == {"s"}
    assert not {-1, -2, -3} & {r["doc_id"] for r in kept.collect()}


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(3)
    for overlap in (0.2, 0.5, 0.8):
        got = []
        for _ in range(40):
            pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
            wa, wb = rng.integers(1, 5, 400), rng.integers(1, 5, 400)
            wa[int(400 * (0.5 + overlap / 2)) :] = 0
            wb[: int(400 * (0.5 - overlap / 2))] = 0
            a, b = (fp.signature(np.repeat(pool, w)) for w in (wa, wb))
            got.append(fp.likeness(a, b) - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
        assert abs(np.mean(got)) < 0.04


def test_fingerprints_brute(spark):
    rng = random.Random(8)
    docs = [(i * 2 - 30, " ".join(rng.choice(["aé", "b", "c🙂", "dd"]) for _ in range(rng.randint(0, 60)))) for i in range(57)]
    docs += [(200, None), (201, ""), (202, "z"), (203, docs[5][1]), (10, "tie"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    sign = lambda t: fp.signature(next(shingle_hashes([t])))
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        want.append((str(d), len(t), hashlib.sha256(new.encode()).hexdigest(), fp.to_hex(sign(t)), fp.to_hex(sign(new)), fp.likeness(sign(t), sign(new)), fp.likeness(sign(t), sign(after))))
    assert sorted((str(r[0]), *r[1:]) for r in fp.fingerprint_report(df).collect()) == sorted(want)
    one = fp.fingerprint_report(df.filter("doc_id = 202")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fp.fingerprint_report(df.limit(0)).count() == 0
    assert fp.fingerprint(df).filter("text is null").first()["fingerprint"] == fp.to_hex(sign(""))


def test_shingles_take_lower_case_words_and_white_space():
    a, b, c = (set(x.tolist()) for x in shingle_hashes(["A b\tC d\x0be F", "a b c d e f", "a b c d e g"]))
    assert a == b and len(a) == 2 and len(a & c) == 1
    rng = random.Random(2)
    for _ in range(300):  # few words, often repeated
        w = [rng.choice("abc") for _ in range(rng.randint(5, 80))]
        assert len(set(next(shingle_hashes([" ".join(w)])).tolist())) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert [len(x) for x in shingle_hashes([None, "", " \n", "a b", "x " * 400000])] == [0, 0, 0, 1, 399996]
