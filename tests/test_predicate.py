"""The predicate language: what parses, binds and is refused."""

import pytest
from pyspark.sql import functions as F

from cedarflow.errors import AmbiguousColumn, SyntaxProblem, TypeMismatch, UnknownColumn
from cedarflow.functions import predicate as p
from cedarflow.operators import relational as ops

GOOD = [
    "(r_name = 'EUROPE')",
    "(r_name < 'middle east') AND\n(r_regionkey > 1)",
    "(c_nationkey = 23) AND (c_mktsegment = 'FURNITURE') AND (c_acctbal > 7023.99) AND (c_acctbal < 7110.83)",
    "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_shipmode = 'MAIL')",
    "(s.s_nationkey = n1.n_nationkey)",
    "(1 < x) AND (-5 = y) AND (-1.5 > z)",
    "(a-b = 'it\\'s')",
    "(ps_suppkey) AND (ps_partkey)",
]
BAD = ["", "r_name = 'X'", "(a = 1", "(a = 1) AND", "(a < 10)\n(b > 100) AND\n(c < 300) AND", "(a <= 1)", "((a = 1))", "(a = 1) OR (b = 2)", "(a = 'x)", "(a =)", "(a = .5)"]


@pytest.mark.parametrize("text", GOOD)
def test_accepts(text):
    tree = p.parse(text)
    assert p.parse(str(tree).replace("it's", "it\\'s")) == tree


@pytest.mark.parametrize("text", BAD)
def test_refuses(text):
    with pytest.raises(SyntaxProblem):
        p.parse(text)


def test_names_may_hold_hyphens():
    assert p.parse("(a-5 < 1)").clauses[0][0].left.value == "a-5"


def test_sort_keys_and_equi_keys():
    assert p.sort_keys("(b) AND (a = a)") == ["b", "a"]
    for bad in ("(a OR b)", "(a = 1)", "(a = b)", "(a < a)"):
        with pytest.raises(SyntaxProblem):
            p.sort_keys(bad)
    sides = ((None, ["a", "b"]), (None, ["c", "d"]))
    assert p.equi_keys("(a = c) AND (d = b) AND (a = 1) AND (a < d) AND (a = c OR b = d) AND (a = b)", sides) == [("a", "c"), ("b", "d")]


def test_binding(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.5, "B"), (3, 3.0, "b")], "i int, d double, s string")
    run = lambda text, **k: [r["i"] for r in ops.select(df, text, **k).orderBy("i").collect()]
    assert run("(i > 1) AND (d < 3.0)") == [2]
    assert run("(i = d)") == [1, 3]
    assert run("(d > 1)") == [2, 3]
    assert run("(s < 'a')") == [2]  # by bytes
    assert run("('a' < s OR 1 = 2)") == [3]
    assert run("(i)") == [1, 2, 3]
    with pytest.raises(TypeMismatch):
        run("(d > 1)", strict=True)
    for text in ("(s = 1)", "(i = 'a')", "(1 = 'a')", "(s = d)"):
        with pytest.raises(TypeMismatch):
            run(text)
    with pytest.raises(UnknownColumn):
        run("(nope = 1)")


def test_dates_compare_with_text(spark):
    df = spark.range(3).select(F.expr("timestamp_ntz'2000-01-01' + make_interval(0,0,0,CAST(id AS INT))").alias("t"))
    assert ops.select(df, "(t > '2000-01-01')").count() == 2


def test_ambiguous(spark):
    df = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(AmbiguousColumn):
        ops.join(df, df, "(k = k)")
    with pytest.raises(AmbiguousColumn):
        ops.join(df, df, "(k = k)", "x", "y")
    assert ops.join(df, df, "(x.k = y.k)", "x", "y").columns == ["x_k", "y_k"]
