"""Line deduplication against a brute force that knows no windows."""

import random

from cedarflow.llm import linededup as ld


def words(line):
    return max(1, len(line.split()))


def counts(run):
    return sum(map(words, run)) >= ld.MIN_RUN and (len(run) > 1 or words(run[0]) >= ld.LONG_LINE)


def brute(docs):
    """By doc_id, the lines to remove: every run that counts and stands before."""
    seen, out = {}, {}
    for d, text in sorted(docs):
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = lines[a : b + 1]
                if counts(run):
                    doc, end = seen.setdefault("\n".join(run), (d, b))
                    if (doc, end) != (d, b):
                        gone |= set(range(max(a, end + 1) if doc == d else a, b + 1))
        out[d] = gone
    return out


def removed(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r["doc_id"]: {int(x) for x in r["removed"].split(",") if x} for r in ld.line_dedup_report(df).collect()}


def other(rng, n):
    return [" ".join(f"o{rng.randrange(10**9)}" for _ in range(9)) for _ in range(n)]


def shared(rng, lines, per_line):
    return [" ".join(f"s{rng.randrange(10**9)}" for _ in range(per_line)) for _ in range(lines)]


def pairs(seed, shapes, each):
    """Documents two by two, with one passage each; and its lines in the second."""
    rng, docs, expected = random.Random(seed), [], {}
    for _ in range(each):
        for lines, per_line in shapes:
            passage = shared(rng, lines, per_line)
            first, again = other(rng, rng.randint(0, 4)) + passage + other(rng, rng.randint(0, 4)), other(rng, k := rng.randint(0, 4)) + passage + other(rng, rng.randint(0, 4))
            expected |= {len(docs): set(), len(docs) + 1: set(range(k, k + lines))}
            docs += [(len(docs), "\n".join(first)), (len(docs) + 1, "\n".join(again))]
    return docs, expected


def test_passages_of_few_lines(spark):
    docs, expected = pairs(1, [(2, 30), (3, 20), (4, 15), (5, 12), (2, 20), (1, 50)], 12)
    docs += [(9000, "\n".join(shared(random.Random(2), 1, 49))), (9001, "\n".join(shared(random.Random(2), 1, 49)))]
    assert removed(spark, docs) == expected | {9000: set(), 9001: set()} == brute(docs)


def test_overlapping_windows_leave_the_first(spark):
    docs = [(1, "\n".join(["spam spam"] * 100)), (2, "\n".join(["x", *["spam spam"] * 30])), (3, "\n".join(["a b c", "d e f g"] * 20))]
    got = removed(spark, docs)
    assert got[1] == set(range(20, 100)) and got[2] == set(range(1, 31))
    assert got == brute(docs)


def test_random_runs(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(100)}" for _ in range(rng.choice([1, 3, 8, 12, 20, 45, 55]))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))) for i in range(60)]
    assert removed(spark, docs) == brute(docs)


def test_windows_with_equal_hashes(spark, monkeypatch):
    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randrange(100)}" for _ in range(rng.choice([12, 20, 45, 55]))) for _ in range(8)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in range(40)]
    real = ld.F.xxhash64
    monkeypatch.setattr(ld.F, "xxhash64", lambda *c: real(*c) if isinstance(c[0], str) else real(*c) % 5)
    assert removed(spark, docs) == brute(docs)


def test_passages_of_short_lines(spark):
    docs, expected = pairs(5, [(60, 1), (500, 1), (30, 2), (100, 2), (34, 2)], 3)
    assert removed(spark, docs) == expected


def test_parts_that_stand_before_hide_nothing(spark):
    rng, docs, expected = random.Random(6), [], {}
    for lines, parts in [(4, 2), (6, 2), (4, 4)] * 8:
        passage = shared(rng, lines, 60 // lines)
        size = lines // parts
        texts = [other(rng, 2) + passage[k : k + size] + other(rng, 2) for k in range(0, lines, size)]
        texts += [other(rng, 3) + passage + other(rng, 2), other(rng, 3) + passage + other(rng, 2)]
        for t in texts:
            expected[len(docs)] = set()
            docs.append((len(docs), "\n".join(t)))
        expected[len(docs) - 1] = set(range(3, 3 + lines))
    assert removed(spark, docs) == expected == brute(docs)


def test_words_by_white_space_and_size(spark):
    rng = random.Random(7)
    han = ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(60)) for _ in range(3)]
    thai = ["".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(70)) for _ in range(3)]
    packed = ["".join(rng.choice("abcdef") for _ in range(600)) for _ in range(2)]
    tabs, wide = ["\t".join(x.split(" ")) for x in shared(rng, 3, 60)], ["\u3000".join(x.split(" ")) for x in shared(rng, 3, 20)]
    gaps = ["   ".join(x.split(" ")) for x in shared(rng, 2, 19)]  # 38 words, however far apart
    docs, expected = [], {}
    for passage, goes in [(han, True), (thai, True), (packed, True), (tabs, True), (tabs[:1], True), (wide, True), (gaps, False), (han[:1], False)]:
        for again in (False, True):
            own = other(rng, 2)
            if passage[0] in (tabs[0], han[0]) and len(passage) == 1:
                again = goes  # stands in an earlier pair
            expected[len(docs)] = set(range(2, 2 + len(passage))) if again and goes else set()
            docs.append((len(docs), "\n".join(own + passage + other(rng, 1))))
    assert removed(spark, docs) == expected
