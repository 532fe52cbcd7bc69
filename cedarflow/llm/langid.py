"""Language identification with averaged hashed subword embeddings.

Subwords are the runs of two to four code points inside words, word ends
included, of the lower-cased text; all that is no letter counts as a word end.
They are hashed to 65,536 buckets.  A text's vector is the mean of its
buckets' embeddings; a linear softmax on top gives the languages.  Embeddings
and softmax are trained together by stochastic gradient descent in numpy on a
bounded sample: at most ``SAMPLE`` labelled rows of each language, every
text whole and in pieces of a few words.  A part of the sample is not trained on
and calibrates the model: a temperature for the probabilities, and the score
and the share of known subwords below which a text is rejected.

Prediction needs, for each bucket, one number a language (embedding times
softmax); it sums these over whole texts, a block at a time.

The sample is bounded for each language: of its distinct rows (by id and text), in
the order of a hash, the first ``SAMPLE``, and no more of them than until
``SAMPLE_BYTES`` of text are reached (the first row always counts; a row gives at
most four examples of at most 65,536 buckets).  So what reaches the driver grows
with the number of languages alone, as the model itself does.  A language with
any labelled row is learnt, whatever its rows' ids are.

Rows: a null text or one without letters is ``und`` with score 0, and rejected; of
two equally likely languages the first in the alphabet is taken; repeated rows, and
rows with equal or null ids, are each answered; a very long text is summed whole,
block by block; without labelled rows every text is ``und``; an empty table gives
an empty one.  Extra columns are not read; those named as the results (lang_pred,
score, rejected) are replaced by :func:`identify` and kept by :func:`keep_identified`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cedarflow.llm.common import BLOCK_CHARS, small_batches, spread, with_own_columns

BITS = 16
SIZES = (2, 3, 4)
DIM = 16
SAMPLE = 500
SAMPLE_BYTES = 16 << 20
EPOCHS = 6
#: Share of the calibration texts whose scores lie below the rejecting threshold.
REJECT = 0.002
UND = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), bool)


def blocks(text: str) -> Iterator[str]:
    """A text in blocks that end with a word, if there is a blank to cut at."""
    i = 0
    while i < len(text):
        j = i + BLOCK_CHARS
        if j < len(text):
            cut = text.rfind(" ", i + 1, j)
            j = cut if cut > i else j
        yield text[i:j]
        i = j


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords, the number of the text each is from, and the
    number of letters of each text.  Together the texts should be a block."""
    joined = "".join([f" {t.lower()} " for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    letter = letters()[codes]
    codes = np.where(letter, codes, np.uint32(0))
    count = np.bincount(owner[letter], minlength=len(texts))
    buckets, owners = [], []
    rolled = codes * np.uint32(0x01000193)
    inner = np.ones(len(codes), bool)
    for n in range(2, max(SIZES) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        if n > 2:
            inner = inner[:m] & letter[n - 2 : n - 2 + m]
        rolled = (rolled[:m] ^ codes[n - 1 : n - 1 + m]) * np.uint32(0x85EBCA6B)
        rolled ^= rolled >> np.uint32(15)
        if n in SIZES:
            ok = inner[:m] & (letter[:m] | letter[n - 1 : n - 1 + m])
            buckets.append(((rolled[ok] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
            owners.append(owner[:m][ok])
    if not buckets:
        return np.empty(0, np.uint32), np.empty(0, np.int32), count
    return np.concatenate(buckets), np.concatenate(owners), count


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, known: np.ndarray):
        self.langs, self.table, self.bias, self.known = langs, table.astype(np.float32), bias, known
        self.temperature, self.least_score, self.least_known = 1.0, 0.0, 0.0

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: sums by language, subwords, known ones, letters."""
        n, k = len(texts), len(self.langs)
        total, count, seen, letter = np.zeros((n, k)), np.zeros(n), np.zeros(n), np.zeros(n)
        group: list[tuple[int, str]] = []

        def flush() -> None:
            buckets, owner, chars = subwords([t for _, t in group])
            own = np.array([i for i, _ in group])
            m = len(group)
            np.add.at(letter, own, chars)
            np.add.at(count, own, np.bincount(owner, minlength=m))
            np.add.at(seen, own, np.bincount(owner, self.known[buckets], m))
            for j in range(k):
                np.add.at(total[:, j], own, np.bincount(owner, self.table[j][buckets], m))
            group.clear()

        held = 0
        for i, text in enumerate(texts):
            for block in blocks(text):
                group.append((i, block))
                held += len(block)
                if held >= BLOCK_CHARS // 2:
                    flush()
                    held = 0
        if group:
            flush()
        return total, count, seen, letter

    def logits(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is rejected, for each text."""
        if not self.langs:
            return [(UND, 0.0, True)] * len(texts)
        total, count, seen, letter = self.sums([t or "" for t in texts])
        p = softmax(self.logits(total, count) / self.temperature)
        best = p.argmax(axis=1)
        out = []
        for i, j in enumerate(best.tolist()):
            if letter[i] == 0:
                out.append((UND, 0.0, True))
            else:
                share = seen[i] / max(1, count[i])
                score = min(1.0, float(p[i, j]))
                out.append((self.langs[j], score, score < self.least_score or share < self.least_known))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pieces(text: str) -> list[str]:
    """What a text is trained on: the whole, and some runs of its words."""
    words = text.split()
    out = [text]
    for size in (4, 12, 40):
        if len(words) > size:
            at = (len(words) - size) // 2
            out.append(" ".join(words[at : at + size]))
    return out


def gather(docs: DataFrame, sample: int, seed: int) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """The sample's examples: language, for calibration, buckets, shares."""
    learnt = docs.filter(~held_out(F.col("doc_id")) | F.col("doc_id").isNull()).filter("lang is not null and text is not null")
    spread_to = 1 << 30
    learnt = learnt.withColumn("key", F.xxhash64("doc_id", "text", F.lit(seed)))
    bin_ = F.shiftrightunsigned("key", 34)  # the upper 30 bits
    counts = {r["lang"]: r["n"] for r in learnt.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not counts:
        return []
    # a little more than the sample by a threshold, then exactly the first ones
    least = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(spread_to * min(1.0, (1.3 * sample + 30) / max(1, n))))])
    some = learnt.filter(bin_ < F.element_at(least, F.col("lang"))).select("lang", "key", F.octet_length("text").cast("long").alias("size"))
    order = Window.partitionBy("lang").orderBy("key")
    ranked = some.groupBy("lang", "key").agg(F.max("size").alias("size")).select(
        "lang", "key", F.row_number().over(order).alias("i"), F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    last = ranked.filter((F.col("i") <= sample) & (F.col("before") < SAMPLE_BYTES)).groupBy("lang").agg(F.max("key").alias("k")).collect()
    ends = F.create_map(*[F.lit(x) for r in sorted(last) for x in (r["lang"], r["k"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            langs, keys, numbers, found, shares = [], [], [], [], []
            for lang, k, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "key", "text")), strict=True):
                for number, piece in enumerate(pieces(text)):
                    joined = [subwords([b])[0] for b in blocks(piece)]
                    buckets, counts = np.unique(np.concatenate(joined), return_counts=True) if joined else ([], [])
                    if len(buckets):
                        langs.append(lang)
                        keys.append(k)
                        numbers.append(number)
                        found.append(buckets.astype(np.int32))
                        shares.append((counts / counts.sum()).astype(np.float32))
            if langs:
                yield pa.RecordBatch.from_pydict({"lang": langs, "key": keys, "piece": numbers, "buckets": found, "shares": shares}, pa.schema([("lang", pa.string()), ("key", pa.int64()), ("piece", pa.int32()), ("buckets", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))]))

    chosen = learnt.filter((bin_ < F.element_at(least, F.col("lang"))) & (F.col("key") <= F.element_at(ends, F.col("lang")))).dropDuplicates(["lang", "key"])
    rows = chosen.select("lang", "key", "text").mapInArrow(run, "lang string, key long, piece int, buckets array<int>, shares array<float>").toArrow()
    order = pa.compute.sort_indices(rows, [("key", "ascending"), ("lang", "ascending"), ("piece", "ascending")]).to_pylist()
    langs, keys = rows["lang"].to_pylist(), rows["key"].to_pylist()
    buckets, shares = (rows[c].combine_chunks() for c in ("buckets", "shares"))
    # views of one array each, so that the driver holds the sample once
    at, found, weights = buckets.offsets.to_numpy(), buckets.values.to_numpy(), shares.values.to_numpy()
    return [(langs[i], keys[i] % 5 == 0, found[at[i] : at[i + 1]], weights[at[i] : at[i + 1]]) for i in order]


def train(examples: list[tuple[str, bool, np.ndarray, np.ndarray]], seed: int = 1) -> Model:
    langs = sorted({e[0] for e in examples})
    n = 1 << BITS
    if not langs:
        return Model([], np.zeros((0, n)), np.zeros(0), np.zeros(n))
    rng = np.random.default_rng(seed)
    fit = [e for e in examples if not e[1]] or examples
    number = {lang: i for i, lang in enumerate(langs)}
    target = np.array([number[e[0]] for e in fit])
    weight = (len(fit) / len(langs) / np.maximum(1, np.bincount(target, minlength=len(langs))))[target]
    emb = rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    out[:] = rng.normal(0, 0.1, out.shape)
    known = np.zeros(n, np.float32)
    for e in fit:
        known[e[2]] = 1
    steps, step = EPOCHS * -(-len(fit) // 32), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for i in range(0, len(order), 32):
            rate = np.float32(1 - step / steps)
            step += 1
            batch = order[i : i + 32]
            buckets, shares = (np.concatenate([fit[j][c] for j in batch]) for c in (2, 3))
            sizes = np.array([len(fit[j][2]) for j in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            mean = np.add.reduceat(emb[buckets] * shares[:, None], np.concatenate(([0], np.cumsum(sizes)[:-1])))
            grad = softmax(mean @ out + bias).astype(np.float32)
            grad[np.arange(len(batch)), target[batch]] -= 1
            grad *= weight[batch, None].astype(np.float32) / len(batch)
            back = grad @ out.T
            out -= rate * 2 * (mean.T @ grad)
            bias -= rate * grad.sum(axis=0)
            np.subtract.at(emb, buckets, rate * 40 * shares[:, None] * back[owner])
    emb[known == 0] = 0
    model = Model(langs, (emb @ out).T, bias, known)
    calibrate(model, [e for e in examples if e[1]] or fit, number)
    return model


def calibrate(model: Model, held: list, number: dict[str, int]) -> None:
    """Temperature by least loss; thresholds by quantiles of right answers."""
    target = np.array([number[e[0]] for e in held])
    z = np.array([(model.table[:, e[2]] * e[3]).sum(axis=1) for e in held]) + model.bias
    rows = np.arange(len(held))
    losses = [(-np.log(np.maximum(softmax(z / t)[rows, target], 1e-12)).mean(), t) for t in np.geomspace(0.05, 8, 60)]
    model.temperature = min(losses)[1]
    p = softmax(z / model.temperature)
    right = p.argmax(axis=1) == target
    share = np.array([(model.known[e[2]] * e[3]).sum() for e in held])
    if right.any():
        model.least_score = min(0.5, float(np.quantile(p.max(axis=1)[right], REJECT)))
        model.least_known = 0.5 * float(np.quantile(share[right], REJECT))


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 1) -> Model:
    model = train(gather(docs, sample, seed), seed)
    pa.default_memory_pool().release_unused()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` (clashing columns go).

    Of each row only the text is looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop("lang_pred", "score", "rejected")
    names, schema = out.columns, StructType(list(out.schema.fields))
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = held.value.predict(batch.column("text").to_pylist())
            new = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "lang_pred", "score", "rejected"])

    return out.mapInArrow(run, schema)


def langid_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.select("doc_id", "text", "lang"))
    return identify(spread(docs.select("doc_id", "text"), "doc_id", "text"), model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns as they came."""
    model = fit(docs.select("doc_id", "text", "lang"))
    return with_own_columns(docs, lambda own: identify(spread(own, "doc_id", "text"), model).filter("not rejected"))
