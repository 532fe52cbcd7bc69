"""The arithmetic language."""

import pytest

from cedarflow.errors import SyntaxProblem, TypeMismatch, UnknownColumn
from cedarflow.functions import arithmetic
from cedarflow.operators import relational as ops


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(7, 2, 3, 1.5, "t")], "a int, b int, c bigint, x double, s string")


@pytest.mark.parametrize(("text", "value", "kind"), [
    ("a * b + c", 35, "Int"), ("a - b - c", 8, "Int"), ("- a + b", -9, "Int"), ("(a + b) / c", 3, "Int"), ("a / b", 3, "Int"),
    ("(- a) / b", -3, "Int"), ("a / x", 7 / 1.5, "Double"), ("a + x * b", 10.0, "Double"), ("(a + (b * 1.05))", 7 + 2 * 1.05, "Double"), ("-5 + a", 2, "Int"), ("3. * b", 6.0, "Double"),
])
def test_from_the_right(df, text, value, kind):
    column, found = arithmetic.bind(text, df)
    assert found == kind and df.select(column.alias("v")).first()["v"] == pytest.approx(value)


@pytest.mark.parametrize(("text", "value"), [("a * b + c", 17), ("a - b - c", 2), ("- a + b", -5), ("a - b * c", 1)])
def test_standard(df, text, value):
    assert df.select(arithmetic.bind(text, df, "standard")[0].alias("v")).first()["v"] == value


@pytest.mark.parametrize("text", ["", "a +", "(a", "a b", "a -5", ".05", "a % b", ") a"])
def test_refuses(df, text):
    with pytest.raises(SyntaxProblem):
        arithmetic.bind(text, df)


def test_types_and_names(df):
    with pytest.raises(TypeMismatch):
        arithmetic.bind("a + s", df)
    with pytest.raises(UnknownColumn):
        arithmetic.bind("a-5", df)  # one name
    with pytest.raises(ValueError):
        arithmetic.bind("a", df, "left")


def test_sums(spark):
    big = spark.createDataFrame([(2**31 - 1,)] * 3, "i int")
    assert ops.sum_of(big, "i").first()["sum"] == 3 * (2**31 - 1)
    d = spark.createDataFrame([(1234567.89,), (0.01,)], "d double")
    assert ops.sum_of(d, "d", scale=2).first()["sum"] == 1234567.9
    assert ops.sum_of(d.limit(0), "d").first()["sum"] is None
