"""The automaton against a search of every window."""

import hashlib
import random
import re

from cedarflow.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    w, hit, found = words(text), set(), []
    for item, it in items:
        iw = words(it)
        wins = [iw[i : i + window] for i in range(max(1, len(iw) - window + 1))] if iw else []
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.append(str(item))
    found = sorted(set(found))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_brute_force(spark):
    rng = random.Random(1)
    vocab = ["a", "bé", "C", "d1", "the", "Of"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 14, 15, 20])))) for i in range(12)] + [(100, None), (101, "?!"), (10, "The of--D1")]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(items)[1] or "" if rng.random() < 0.5 else " ".join(rng.choice([*vocab, "zz"]) for _ in range(rng.randint(1, 30))))
        docs.append((i, rng.choice([" ", "\n", ", "]).join(parts).upper() if i % 3 else " ".join(parts)))
    docs += [(60, None), (61, ""), (61, ""), (None, "x the of d1 y")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *brute(t, items)) for i, t in docs)
    for block in (decontam.BLOCK_BYTES, 60):  # one block, and several
        marked = decontam.mark_contamination(d, b, block_bytes=block)
        got = sorted((str(r["doc_id"]), r["n_words"], sum(h["end"] - h["start"] for h in r["hit_words"]), len(r["hit_items"]), hashlib.sha256(",".join(r["hit_items"]).encode()).hexdigest()) for r in marked.collect())
        assert got == [w[:5] for w in want]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination_report(d, b).collect())
    assert got == want
    last = [r for r in decontam.contamination_report(d, b).collect() if r["doc_id"] is None][0]
    assert [(s["start"], s["end"]) for s in last["hit_spans"]] == [(2, 11)]


def test_empty_and_clashing(spark):
    d = spark.createDataFrame([(1, "a b", 5, "k")], "doc_id long, text string, n_words int, extra string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination_report(d, none).collect()[0]["n_hit"] == 0
    assert decontam.contamination_report(d.limit(0), none).count() == 0
    assert decontam.drop_contaminated(d, none).schema == d.schema and decontam.drop_contaminated(d, none).collect() == d.collect()
