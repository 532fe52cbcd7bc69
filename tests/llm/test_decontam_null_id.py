"""Benchmark items without an id, against the query's SQL."""

import duckdb

from cedarflow.llm import decontam
from cedarflow.llm.queries import ORACLES


def test_items_with_a_null_id_are_hit(spark):
    d = spark.createDataFrame([(1, "own a b c"), (2, "a b c d e"), (3, "d e"), (4, "none")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "a b c"), (7, "d e"), (None, None), (8, None)], "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        con.register(name, df.toArrow())
    want = sorted(con.sql(ORACLES["op9_decontamination"]).fetchall())
    assert [r[2] for r in want] == [3, 5, 2, 0]
    got = decontam.contamination_report(d, b).drop("hit_spans")
    assert sorted(tuple(r) for r in got.collect()) == want
    for block in (decontam.BLOCK_BYTES, 3):  # one block, and several
        marked = decontam.mark_contamination(d, b, block_bytes=block)
        assert {r["doc_id"]: r["hit_items"] for r in marked.collect()} == {1: [None], 2: [None, "7"], 3: ["7"], 4: []}
    assert {r["doc_id"] for r in decontam.drop_contaminated(d, b).collect()} == {4}
