"""Line deduplication against a brute force that knows runs, not chunks."""

import os
import random
import time

import xxhash

from cedarflow.llm import linededup as ld
from tests.llm.test_linededup_runs import counts


def brute(docs):
    """Every run of lines that counts and stands before, in the order of doc_id and
    a hash of the text, goes; rows equal in both are one document."""
    signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n
    key = lambda d, t: (-(2**63) if d is None else d, signed(xxhash.xxh64_intdigest((t or "").encode(), seed=42)))
    seen, gone = {}, {}
    for k, t in sorted({key(d, t): t for d, t in docs}.items()):
        lines, gone[k] = t.split("\n") if t else [], set()
        for a in range(len(lines)):
            for b in range(a, min(len(lines), a + 2 * ld.MIN_RUN)):
                if counts(lines[a : b + 1]):
                    first, end = seen.setdefault("\n".join(lines[a : b + 1]), (k, b))
                    if (first, end) != (k, b):
                        gone[k] |= set(range(max(a, end + 1) if first == k else a, b + 1))
    out = []
    for d, t in docs:
        lines, g = t.split("\n") if t else [], gone[key(d, t)]
        out.append((str(d), len(lines), ",".join(map(str, sorted(g))), "\n".join(x for i, x in enumerate(lines) if i not in g) if g else t))
    return sorted(out, key=repr)


def test_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice(["ab", "cé", "d", "efg"]) + str(rng.randint(0, 99)) for _ in range(rng.choice([1, 4, 9, 12]))) for _ in range(60)]
    passage = [" ".join(f"p{i}w{j}" for j in range(13)) for i in range(6)]
    single = " ".join(f"s{j}" for j in range(55))
    docs = []
    for i in range(120):
        lines = [rng.choice(pool) if rng.random() < 0.3 else f"own {i} {j} " + rng.choice(pool) for j in range(rng.randint(0, 12))]
        if i % 3 == 0:
            lines[len(lines) // 2 : len(lines) // 2] = passage
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), single)
        docs.append((i, "\n".join(lines)))
    docs += [(3, docs[3][1]), (500, docs[3][1]), (None, docs[9][1]), (501, None), (502, ""), (503, "\n\n\n"), (504, "x " * 90000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((str(r["doc_id"]), r["n_lines"], r["removed"], r["text"]) for r in ld.line_dedup_report(df).collect()), key=repr)
    assert got == brute(docs)
    # the whole passage goes wherever the long line does not part it, and the first stays
    held = {d for d, _, _, t in got if any(p in (t or "") for p in passage)}
    assert "None" in held and all(d == "None" or int(d) % 12 == 0 for d in held)
    assert sum((t or "").count(single) for _, _, _, t in got) == 1


def test_pipeline_form(spark):
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, line, 5, "a"), (2, line, 5, "b"), (3, "hello\n" + line, 5, "c"), (4, None, None, "d"), (5, "own text", 8, "e")], "doc_id long, text string, n_chars int, n_lines string")
    out = ld.keep_first_lines(docs)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, line, 5), (3, "hello", 5), (4, None, None), (5, "own text", 8)]
    assert ld.line_dedup_report(docs.limit(0)).count() == 0


def test_many_equal_lines(spark):
    """Time in proportion to the lines, and only the first run of 40 words stays."""
    docs = [(1, "\n".join(["same line here"] * 100_000)), (2, "\n".join(["a"] * 100_000)), (3, "\n".join([" " * 50 + "}"] * 30))]
    began = time.time()
    got = {r["doc_id"]: r for r in ld.line_dedup_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert (got[1]["n_lines"], got[1]["n_removed"]) == (100_000, 100_000 - 14) and got[1]["text"] == "\n".join(["same line here"] * 14)
    assert got[2]["n_removed"] == 100_000 - 40 and got[3]["n_removed"] == 0


def test_no_table_but_the_ranges_is_left(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    ld.dedup_lines(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")).collect()
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} <= {"ranges"}
