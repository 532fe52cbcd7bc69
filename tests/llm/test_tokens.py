"""Encoding by pieces, token files and packing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cedarflow.llm import packing, tokenbin
from cedarflow.llm.common import fresh_path
from cedarflow.llm.tokens import Encoder, public_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
BITS = [" ", "\n", "\t", "a", "B", "é", "ß", "1", "23", ".", ",", "'s", "'ll", "  ", "\x1c", "İ", "Σ", "σ", "́", "漢", "<|endoftext|>", "<|", "\r", "\u0085", "-", "🙂", "\x01", "the", " of"]
DOCS = [(5, "Hello world"), (1, None), (3, ""), (2, "a  b\n\nc <|endoftext|> d"), (2, "tie"), (2, "tie"), (None, "no id"), (9, "word " * 9000)]


@pytest.mark.parametrize("name", FILES)
def test_same_ids_as_whole_texts(name):
    code, plain = Encoder(public_path(name)), Tokenizer.from_file(public_path(name))

    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.sampled_from(BITS), max_size=25).map("".join))
    def check(text):
        assert code.encode([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    check()
    rng = random.Random(1)
    texts = ["".join(rng.choice(BITS) for _ in range(40)) for _ in range(3000)]
    assert code.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]


def ids(text, name, end):
    return Tokenizer.from_file(public_path(name)).encode(text or "", add_special_tokens=False).ids + [end]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_files(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    got = sorted(((r["start"], str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in tokenbin.token_file_report(df).collect()))
    starts, want = 0, []
    for d, t in sorted(DOCS, key=lambda x: (x[0] is not None, x[0])):
        x = ids(t, "byte_bpe_50k.json", 2)
        want.append((starts, str(d), len(x), crc(x)))
        starts += len(x)
    assert [g[0] for g in got] and Counter(g[1:] for g in got) == Counter(w[1:] for w in want)
    assert [g[1] for g in got] == [w[1] for w in want]  # in ascending order, gapless
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False)) and got[0][0] == 0
    assert tokenbin.token_file_report(df.limit(0)).count() == 0


def test_files_are_plain(spark):
    url = fresh_path(spark, "tokens")
    df = spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id long, text string")
    manifest = tokenbin.write_tokens(df, url, "byte_bpe_50k.json")
    folder, found = tokenbin.Folder(url), []
    for part in manifest["parts"]:
        found += np.array(folder.array(part["name"] + ".bin", manifest["dtype"])).tolist()
    assert found == ids("a", "byte_bpe_50k.json", 2) + ids("b c", "byte_bpe_50k.json", 2) and manifest["dtype"] == "<u2"


def check_packing(rows, docs, capacity):
    sequences = defaultdict(list)
    pieces = Counter()
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    want = Counter()
    for d, t in docs:
        x = ids(t, "word_bpe_49k.json", 0)
        for k, i in enumerate(range(0, len(x), capacity)):
            part = x[i : i + capacity]
            want[(d, k, i, len(part), crc(part))] += 1
    assert pieces == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(k[3] * n for k, n in want.items()) // capacity)


def test_packing(spark):
    rng = random.Random(3)
    docs = [*DOCS, *[(100 + i, " ".join(rng.choice(["the", "of", "qx"]) for _ in range(rng.randint(0, 700)))) for i in range(120)]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for capacity in (2048, 128):
        used, least = check_packing(packing.pack(df, capacity=capacity).collect(), docs, capacity)
        assert used <= least + 2
    assert packing.pack(df.limit(0)).count() == 0


def test_plan():
    rng = random.Random(7)
    for _ in range(60):
        capacity = rng.choice([10, 37, 64])
        counts = {n: rng.choice([1, 2, 50, 10**9]) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(12, capacity)))}
        plan = packing.Plan(counts, capacity)
        placed = Counter()
        for lengths, n in plan.made:
            assert n > 0 and sum(k * c for k, c in lengths.items()) <= capacity
            for k, c in lengths.items():
                placed[k] += c * n
        assert placed == counts and len(plan.made) < 200
    assert packing.Plan({6: 5, 4: 3, 2: 1, 1: 4}, 10).made[:2] == [(Counter({6: 1, 4: 1}), 3), (Counter({6: 1, 2: 1, 1: 2}), 1)]
