"""The pipeline's stages, one by one and together."""

from collections import defaultdict

import corpus_pipeline
from cedarflow.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.read_table(spark, SF, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = common.materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "lines":
            assert all(before[k] == t for k, t in after.items())
        sizes.append(len(after))
    assert sizes[0] >= sizes[1] > 0.95 * sizes[0] and sizes[2] > 0.8 * sizes[1] and sizes[4] > 0.6 * sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(last) == key(whole)
    used = defaultdict(int)
    for r in whole:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 2


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, text.replace("w7 ", f"z{i} "), "en", "s", 5) for i in range(40)] + [(99, "quite another text about other things", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 99]
