"""Document fingerprints by consistent weighted sampling.

A text's terms are its five-word shingles (the whole sequence if it has fewer
words), weighted by how often they occur.  For each of ``samples`` samples a
term's hash picks r and c, gamma(2, 1) distributed, and beta, uniform; with
weight s, t = floor(ln s / r + beta), and the term with the least
ln c - r * (t - beta) - r, together with t, is the sample.  Two texts agree in a
sample with a probability equal to the generalised Jaccard similarity of their
weighted terms.  The (r, c, beta) come from a table of 65,536 drawn once; equal
values go to the smaller hash.  A sample is kept as 16 bits, four hex digits.

Rows: null and empty texts (and texts without words) have no terms and share
one constant fingerprint; equal texts have equal fingerprints; repeated rows, and
rows with equal or null ids, are each answered.  A null id comes last, and rows of
one id stand in the order of their texts; many of them are dealt to several tasks by
their texts' beginnings, and those that agree in ``BEGINNING`` code points pass through
one, a batch at a time.  A very long text is read whole, its terms a block at a time;
an empty table gives an empty one.  Extra columns are not read by
:func:`fingerprint_report` and kept by :func:`fingerprint`, which replaces one that
is named as its result.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarflow.llm.common import partitions_of, small_batches
from cedarflow.llm.shingles import U, mix, shingle_hashes

SAMPLES = 64
ROWS = 1024
#: Code points by which the rows of one id are dealt; beginnings seen for a bucket.
BEGINNING = 64
SIGHTS = 20


@lru_cache(maxsize=1)
def variates(samples: int) -> tuple[np.ndarray, ...]:
    """Multipliers by sample; ln c, r and beta; and what a term of weight 1 has."""
    rng = np.random.default_rng(6)
    multipliers = rng.integers(1, 1 << 63, samples, dtype=U) * U(2) + U(1)
    r, c, beta = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
    lnc = np.log(c)
    return multipliers, lnc, r, beta, (lnc + r * beta - r).astype(np.float32)


def signature(terms: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The samples, as unsigned 16-bit integers, of a text's term hashes."""
    if not len(terms):
        return np.zeros(samples, np.uint16)
    multipliers, lnc, r, beta, one = variates(samples)
    terms, counts = np.unique(terms, return_counts=True)
    heavy = counts > 1
    least, arg, step = np.full(samples, np.inf, np.float32), np.zeros(samples, U), np.zeros(samples, np.int64)
    light = terms[~heavy]
    for i in range(0, len(light), ROWS):
        part = light[i : i + ROWS]
        value = one[((multipliers[:, None] * part[None, :]) >> U(48)).astype(np.intp)]
        at = value.argmin(axis=1)
        found = value[np.arange(samples), at]
        less = (found < least) | (found == least) & (part[at] < arg)
        least[less], arg[less] = found[less], part[at][less]
    for i in range(0, int(heavy.sum()), ROWS):
        part, ln = terms[heavy][i : i + ROWS], np.log(counts[heavy][i : i + ROWS])
        k = ((multipliers[:, None] * part[None, :]) >> U(48)).astype(np.intp)
        t = np.floor(ln / r[k] + beta[k])
        value = (lnc[k] - r[k] * (t - beta[k]) - r[k]).astype(np.float32)
        at = value.argmin(axis=1)
        rows = np.arange(samples)
        found = value[rows, at]
        less = (found < least) | (found == least) & (part[at] < arg)
        least[less], arg[less], step[less] = found[less], part[at][less], t[rows, at][less].astype(np.int64)
    return (mix(arg + step.astype(U) * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.uint16)


def to_hex(signed: np.ndarray) -> str:
    return signed.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """``docs`` with the fingerprint of ``text_col`` (a clashing column is replaced)."""
    @F.pandas_udf("string")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series([to_hex(signature(h, samples)) for h in shingle_hashes(list(texts))], index=texts.index)

    return docs.withColumn(out_col, signed(F.col(text_col).cast("string")))


def cut_points(picked: DataFrame, n: int) -> list[tuple[bool, int, str]]:
    """Where buckets of about an ``n``-th of the rows begin, as keys of :func:`place`.

    They are quantiles of doc_id.  An id that holds several of them, or none as a
    null, is cut further at beginnings of its texts, of which one in so many is
    looked at that about ``SIGHTS`` stand for each bucket.
    """
    found = picked.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("c"), F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    shares = Counter(found["c"] or [])
    if found["rows"] > found["ids"]:
        shares[None] = math.ceil(n * (1 - found["ids"] / found["rows"]))
    cuts = [(c is None, ~c if c is not None else 0, "") for c in shares]
    heavy = {c: m for c, m in shares.items() if m > 1}
    every = found["rows"] // (SIGHTS * n) + 1
    if heavy and found["rows"] > n:
        ids = F.col("doc_id").isin([c for c in heavy if c is not None])
        chosen = picked.filter(F.coalesce(ids, F.lit(None in heavy))).select("doc_id", beginning().alias("p")).filter(F.pmod(F.xxhash64("p"), F.lit(every)) == 0)
        seen: dict[int | None, list[str]] = {}
        for r in chosen.distinct().collect():
            seen.setdefault(r["doc_id"], []).append(r["p"])
        for c, texts in seen.items():
            texts.sort()
            picks = {texts[i * len(texts) // heavy[c]] for i in range(1, heavy[c])}
            cuts += [(c is None, ~c if c is not None else 0, p) for p in picks if p]
    return sorted(cuts)


def beginning() -> Column:
    return F.coalesce(F.substring("text", 1, BEGINNING), F.lit(""))


def place() -> Column:
    """A row's key in the order of descending doc_id, null last, then text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("less"), beginning().alias("p"))


def bucket_of(cuts: list[tuple[bool, int, str]]) -> Column:
    """How many of the cuts a row's key has reached; they are looked through by
    groups first, then within one."""
    width = math.isqrt(len(cuts)) + 1
    groups = [[dict(zip(("none", "less", "p"), c, strict=True)) for c in cuts[i : i + width]] for i in range(0, len(cuts), width)]
    kind = "struct<none: boolean, less: long, p: string>"
    firsts = F.from_json(F.lit(json.dumps([g[0] for g in groups])), f"array<{kind}>")
    members = F.from_json(F.lit(json.dumps(groups)), f"array<array<{kind}>>")

    def reached(bounds: Column, key: Column) -> Column:
        return F.size(F.filter(bounds, lambda c: c <= key))

    def bucket(x: Column) -> Column:
        return F.when(x["g"] > 0, (x["g"] - 1) * width + reached(F.get(members, x["g"] - 1), x["key"])).otherwise(0)

    # a lambda's argument is worked out once, an expression within one for every cut
    keyed = F.transform(F.array(place()), lambda k: F.struct(k.alias("key"), reached(firsts, k).alias("g")))
    return F.get(F.transform(keyed, bucket), F.lit(0)).cast("int")


def neighbours(docs: DataFrame) -> DataFrame:
    """``docs`` dealt into buckets by doc_id, descending, then text, every bucket
    followed by the first row of the next one (``ghost``), the last by the very first.

    The number of buckets is that of the shuffle partitions, so what the driver
    holds does not grow with the rows.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = picked.withColumn("bucket", bucket_of(cut_points(picked, 3 * partitions_of(spark))))
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()
    order = sorted(((r["bucket"], r["head"]) for r in heads), key=lambda x: x[0])
    if not order:
        return dealt.withColumn("ghost", F.lit(False)).limit(0)
    # the bucket before each head; the last for the first
    small = spark.createDataFrame([(b, order[i - 1][0], head) for i, (b, head) in enumerate(order)], "own int, before int, head long")
    of_head = (dealt["bucket"] == small["own"]) & dealt["doc_id"].eqNullSafe(small["head"])
    ghosts = dealt.join(F.broadcast(small), of_head).groupBy("before", "doc_id").agg(F.min(F.struct("text")).alias("first"))
    ghosts = ghosts.select("doc_id", F.col("first.text").alias("text"), F.col("before").alias("bucket"), F.lit(True).alias("ghost"))
    both = dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    return both.repartition(partitions_of(spark), "bucket").sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))


def edited(text: str, after: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``after``."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def fingerprint_report(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Every text's fingerprint and its edited text's, and what they are like.

    Neighbours with equal doc_ids stand in the order of their texts, null first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # the row that waits for the next one
        for batch in small_batches(batches, "text"):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "ghost")), strict=True))
            signs = [signature(h, samples) for h in shingle_hashes([r[1] for r in rows])]
            pairs = []
            for (doc_id, text, bucket, ghost), sign in zip(rows, signs, strict=True):
                if held is not None and held[2] == bucket:
                    pairs.append((held, text or "", sign))
                held = None if ghost else (doc_id, text or "", bucket, sign)
            changed = [edited(h[1], after) for h, after, _ in pairs]
            out = []
            for (h, _, sign), new, terms in zip(pairs, changed, shingle_hashes(changed), strict=True):
                other = signature(terms, samples)
                out.append((h[0], len(h[1]), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), to_hex(h[3]), to_hex(other), likeness(h[3], other), likeness(h[3], sign)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return neighbours(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
