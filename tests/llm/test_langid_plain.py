"""Language ID: the sample's bounds, and scores computed anew letter by letter."""

import math
from collections import Counter

import numpy as np

from cedarflow.llm import langid

MASK = (1 << 32) - 1


def rows(n, lang, doc_id=None, words="alpha beta gamma delta"):
    return [(doc_id, f"{words} number {i} of {lang}", lang) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_sample_is_bounded_whatever_the_ids_are(spark, monkeypatch):
    data = rows(300, "aa") + rows(300, "bb", 1) + [(i, "one text for all of them", "cc") for i in range(300)] + [(1, "the very same row", "dd")] * 300 + rows(1, "ee")
    for seed in (0, 1, 2):
        got = Counter(e[0] for e in langid.gather(frame(spark, data), 50, seed))
        texts = {"aa": 50, "bb": 50, "cc": 50, "dd": 1, "ee": 1}
        assert got == {lang: n * len(langid.pieces({"aa": data[0], "bb": data[300], "cc": data[600], "dd": data[900], "ee": data[-1]}[lang][1])) for lang, n in texts.items()}
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 500)
    long = [(i, f"{i} " + "word " * 200, "aa") for i in range(40)]
    assert len(langid.gather(frame(spark, long), 50, 1)) == len(langid.pieces(long[0][1]))


def test_same_sample_however_the_rows_are_dealt(spark):
    df = frame(spark, rows(200, "aa") + rows(200, "bb", 1))
    a, b = (langid.gather(d, 40, 1) for d in (df.repartition(7), df.coalesce(1)))
    assert [e[:2] for e in a] == [e[:2] for e in b] and all((x[2] == y[2]).all() and (x[3] == y[3]).all() for x, y in zip(a, b, strict=True))


def plain_gram_hash(gram):
    """As the rolled hash: each code point but the first is mixed in turn."""
    h = gram[0] * 0x01000193 & MASK
    for c in gram[1:]:
        h = (h ^ c) * 0x85EBCA6B & MASK
        h ^= h >> 15
    return (h + len(gram)) * 0x9E3779B1 % (1 << 32) >> 32 - langid.BITS


def plain_buckets(text):
    """Buckets of the runs of 2 to 4 code points inside words, ends included."""
    codes = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    out = []
    for n in langid.SIZES:
        for i in range(len(codes) - n + 1):
            gram = codes[i : i + n]
            if not all(gram[1:-1]) or not (gram[0] or gram[-1]):
                continue
            out.append(plain_gram_hash(gram))
    return out


def test_scores_computed_anew(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, 60)
    texts = [r["text"] for r in docs.limit(40).collect()] + ["Ünïcode Straße!", "a", "x1y2", "12 3", "", "the and " * 3000]
    for text, (lang, score, _) in zip(texts, model.predict(texts), strict=True):
        buckets = plain_buckets(text or "")
        assert sorted(buckets) == sorted(langid.subwords([text or ""])[0].tolist())
        if not any(c.isalpha() for c in (text or "").lower()):
            assert (lang, score) == (langid.UND, 0.0)
            continue
        z = [(sum(float(model.table[j][b]) for b in buckets) / max(1, len(buckets)) + float(model.bias[j])) / model.temperature for j in range(len(model.langs))]
        e = [math.exp(x - max(z)) for x in z]
        best = int(np.argmax(e))
        assert lang == model.langs[best] and abs(score - e[best] / sum(e)) < 1e-5


def test_long_text_is_summed_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, 60)
    text = " ".join(r["text"] for r in docs.limit(60).collect() if r["text"]) * 6
    assert len(text) > 2 * langid.BLOCK_CHARS or len(text) > 100000
    total, count, _, _ = model.sums([text])
    once = langid.subwords([text])[0]
    assert count[0] == len(once) and np.allclose(total[0], [model.table[j][once].sum(dtype=np.float64) for j in range(len(model.langs))], rtol=1e-6)


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello there", "en", "k", 1.5), (2, None, "en", "k", 1.5)], "doc_id long, text string, lang string, lang_pred string, rejected double")
    assert langid.keep_identified(df.limit(0)).columns == df.columns and langid.keep_identified(df.limit(0)).count() == 0
    out = langid.keep_identified(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "hello there", "en", "k", 1.5)]
