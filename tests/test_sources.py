"""Catalogs, delimited files and stored tables."""

import pytest
from pyspark.sql import types as T

from cedarflow.errors import EngineError, SyntaxProblem, UnknownColumn
from cedarflow.sources import catalog, delimited, tables

TEXT = "BEGIN\nitem\nitem.tbl\nk Int\nd Double\ns String\nEND\n\nBEGIN\nother\no.tbl\nx String\nEND\n"


def test_catalog(tmp_path):
    found = catalog.parse_catalog(TEXT)
    assert found["item"].file == "item.tbl" and [f.dataType for f in found["item"].schema] == [T.IntegerType(), T.DoubleType(), T.StringType()]
    for bad in ("BEGIN\na\nb\nc Int", "x", "BEGIN\na\nb\nc Date\nEND", "BEGIN\na\nb\nEND"):
        with pytest.raises(SyntaxProblem):
            catalog.parse_catalog(bad)
    with pytest.raises(UnknownColumn):
        catalog.relation_of(found, "nope")


def test_delimited(spark, tmp_path):
    (tmp_path / "item.tbl").write_text('1|2.5|say "hi"|\n2|||\n12ab|1e2x|c|\nzz|.5|d|\n')
    schema = catalog.parse_catalog(TEXT)["item"].schema
    path = str(tmp_path / "item.tbl")
    assert [tuple(r) for r in delimited.read_tbl(spark, path, schema).collect()][:2] == [(1, 2.5, 'say "hi"'), (2, None, "")]
    assert [tuple(r) for r in delimited.read_tbl(spark, path, schema, lenient=True).collect()] == [(1, 2.5, 'say "hi"'), (2, 0.0, ""), (12, 100.0, "c"), (0, 0.5, "d")]
    df = delimited.read_tbl(spark, path, schema).limit(2)
    delimited.write_tbl(df, str(tmp_path / "out"))
    assert delimited.read_tbl(spark, str(tmp_path / "out"), schema).exceptAll(df).count() == 0
    assert [tuple(r) for r in catalog.rows_of(spark, schema, ["5|1.5|x|"]).collect()] == [(5, 1.5, "x")]
    assert tables.filter_file(spark, path, schema, "(k = 2)").count() == 1


def test_heap(spark, tmp_path):
    schema = catalog.parse_catalog(TEXT)["item"].schema
    t = tables.create(spark, str(tmp_path / "heap"), schema)
    assert t.scan().count() == 0
    t.add([(1, 1.0, "a"), (2, 2.0, "b")])
    t.append(spark.createDataFrame([("c", 3, 3.0)], "s string, k int, d double"))
    again = tables.open_table(spark, str(tmp_path / "heap"))
    assert again.kind == "heap" and sorted(r["k"] for r in again.rows("(k > 1)")) == [2, 3]
    (tmp_path / "item.tbl").write_text("9|9.0|z|\n")
    again.load(str(tmp_path / "item.tbl"))
    again.load(str(tmp_path / "item.tbl"))
    assert again.scan().count() == 5


def test_sorted(spark, tmp_path):
    schema = catalog.parse_catalog(TEXT)["item"].schema
    t = tables.create(spark, str(tmp_path / "s"), schema, "sorted", "(s) AND (k)")
    assert t.scan().count() == 0
    t.add([(3, 1.0, "b"), (1, 1.0, "c")])
    assert [r["k"] for r in t.rows()] == [3, 1]
    t.add([(2, 1.0, "a"), (1, 1.0, "b")])
    t.close()
    again = tables.open_table(spark, str(tmp_path / "s"))
    assert again.keys == ["s", "k"] and [(r["s"], r["k"]) for r in again.rows()] == [("a", 2), ("b", 1), ("b", 3), ("c", 1)]
    assert again.key_prefix("(s = 'b') AND (d > 0.5)") == ["s"] and again.key_prefix("(k = 1)") == []
    assert again.lookup("(s = 'b') AND (k > 1)").count() == 1


def test_kinds(spark, tmp_path):
    schema = catalog.schema_of([("k", "Int")])
    with pytest.raises(NotImplementedError):
        tables.create(spark, str(tmp_path / "t"), schema, "tree")
    for kind, keys, error in (("odd", (), EngineError), ("sorted", (), EngineError), ("sorted", ["z"], UnknownColumn)):
        with pytest.raises(error):
            tables.create(spark, str(tmp_path / "t"), schema, kind, keys)
    with pytest.raises(EngineError):
        tables.open_table(spark, str(tmp_path / "none"))


def test_settings(spark, tmp_path):
    (tmp_path / "cat").write_text(TEXT)
    (tmp_path / "item.tbl").write_text("1|1.0|a|\n")
    (tmp_path / "set").write_text(f"{tmp_path}/cat\n\n{tmp_path}/\n")
    h = tables.handle(tables.read_settings(str(tmp_path / "set")), "item")
    df = h.read(spark)
    assert df.filter(h.predicate(df, "(k = 1)")).count() == 1 and h.order("(k)") == ["k"] and h.expression(df, "k + d")[1] == "Double"
    (tmp_path / "set").write_text("x")
    with pytest.raises(EngineError):
        tables.read_settings(str(tmp_path / "set"))


def test_earlier_scans_outlive_merges(spark, tmp_path):
    schema = catalog.schema_of([("k", "Int")])
    t = tables.create(spark, str(tmp_path / "s"), schema, "sorted", "(k)")
    t.add([(3,), (1,)])
    early = t.scan()
    for k in range(20, 20 + tables.MOST_RUNS + 1):
        t.add([(k,)])
        t.merge()
    assert len(t.meta["runs"]) <= tables.MOST_RUNS and [r["k"] for r in early.collect()] == [1, 3]
    assert [r["k"] for r in tables.open_table(spark, t.path).rows()] == [1, 3, *range(20, 29)]
    t.vacuum()
    assert [r["k"] for r in tables.open_table(spark, t.path).rows()] == [1, 3, *range(20, 29)]
    assert len(list((tmp_path / "s").glob("table-*.json"))) == 1


def test_two_writers_do_not_make_one_state(spark, tmp_path):
    schema = catalog.schema_of([("k", "Int")])
    a = tables.create(spark, str(tmp_path / "s"), schema, "sorted", "(k)")
    b = tables.open_table(spark, a.path)
    a.add([(1,)])
    a.merge()
    b.add([(2,)])
    with pytest.raises(EngineError):
        b.merge()
    assert [r["k"] for r in tables.open_table(spark, a.path).rows()] == [1]


def test_values_that_the_format_cannot_hold(spark, tmp_path):
    for bad in ("a|b", "a\nb", "a\rb"):
        with pytest.raises(Exception, match="a delimited file cannot hold"):
            delimited.write_tbl(spark.createDataFrame([(1, "fine"), (2, bad)], "k int, s string"), str(tmp_path / "bad"))
