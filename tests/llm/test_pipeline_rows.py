"""Every stage over odd rows, and the stages that filter against brute force."""

import os

import pytest

import corpus_pipeline
from cedarflow.llm import common
from tests.llm import test_decontam, test_minhash

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score string, n int, hit_words string, `_own_0` string, removed_lines int, sequence_id string"
PASSAGE = "\n".join(" ".join(f"p{i}w{j}" for j in range(15)) for i in range(4))
PROSE = "the people of the old town went to the river and talked about the weather of the day"


def rows():
    texts = [(1, PROSE + " once more"), (2, None), (3, ""), (4, " \n\t"), (5, "12 34 !"), (6, PROSE + "\n" + PASSAGE), (7, "another beginning of it\n" + PASSAGE), (7, "another beginning of it\n" + PASSAGE),
             (8, PASSAGE), (None, PROSE + " without an id"), (None, None), (9, (PROSE + " ") * 20000), (10, "x" * 300000), (11, "one"), (12, "one"), (-1, "\n".join(["equal lines of it"] * 3000)), (1, PROSE + " once more")]
    return [(d, t, "en", "s", None if t is None else len(t), "k", k, "h", "o", 7, "q") for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_odd_rows(spark, odd, name):
    out = STAGES[name](spark, odd, SF)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in odd.schema]
    got = out.collect()
    own = {r[6]: r for r in rows()}
    for r in got:  # nothing but the text and its length is changed, and that by one stage
        same = tuple(r) == own[r["n"]] or name == "lines" and tuple(r)[2:4] + tuple(r)[5:] == own[r["n"]][2:4] + own[r["n"]][5:]
        assert same, r["n"]
    kept = {r["n"]: r["text"] for r in got}
    if name == "language":  # without a letter there is no language; equal texts are judged alike
        assert not {1, 2, 3, 4, 10} & set(kept) and (0 in kept) == (16 in kept) and (6 in kept) == (7 in kept)
    else:  # 8 is the passage alone, in lines a repetition and near to 6; 14 is equal to 13
        gone = {"lines": {8}, "near_duplicates": {8, 14}, "decontaminate": set()}[name]
        assert set(kept) == set(range(17)) - gone
    if name == "lines":
        assert kept[5] == own[5][1] and kept[6] == kept[7] == "another beginning of it" and len(kept[15].split("\n")) == 10
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    empty = STAGES[name](spark, odd.limit(0), SF)
    assert empty.count() == 0 and empty.columns == odd.columns


def test_packing_odd_rows(spark, odd):
    got = STAGES["packed"](spark, odd, SF).collect()
    assert len({(r["doc_id"], r["piece"]) for r in got if r["piece"] == 0}) == len({d[0] for d in rows()}) and sum(r["piece"] == 0 for r in got) == len(rows())
    assert STAGES["packed"](spark, odd.limit(0), SF).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    docs = common.read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = {i for i, _, _, stays in test_minhash.brute(rows, corpus_pipeline.SIMILAR) if stays}
    assert {r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, SF).collect()} == kept


def test_decontaminate_against_all_windows(spark):
    docs = common.read_table(spark, SF, "documents")
    items = [(r["item_id"], r["text"]) for r in common.read_table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[i : i + 13]) for _, t in items for w in [test_decontam.words(t)] if w for i in range(max(1, len(w) - 12))}
    kept = set()
    for r in docs.collect():
        w, hit = test_decontam.words(r["text"]), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            kept.add(r["doc_id"])
    assert {r["doc_id"] for r in STAGES["decontaminate"](spark, docs, SF).collect()} == kept


def test_tables_of_earlier_stages_are_deleted(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, SF).count()
    assert sorted(x.split("-")[0] for x in set(os.listdir(folder)) - before) == ["decontaminate", "pieces"]
