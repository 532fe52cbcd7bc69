"""Select, project, join, sum, group, distinct, sort and write-out.

Every operator is a lazy DataFrame composition; Catalyst chooses scans, joins
and aggregation, and nothing here looks at rows.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cedarflow.errors import AmbiguousColumn, UnknownColumn
from cedarflow.functions import DOUBLE, INT, STRING, arithmetic, kind_of, predicate


def select(df: DataFrame, condition: str | predicate.Predicate, strict: bool = False) -> DataFrame:
    """The rows for which the predicate holds."""
    return df.filter(predicate.bind(condition, df, strict))


def project(df: DataFrame, keep: Sequence[int | str]) -> DataFrame:
    """The columns with these numbers or names, in the order given."""
    names = []
    for k in keep:
        if isinstance(k, int) and not 0 <= k < len(df.columns) or isinstance(k, str) and k not in df.columns:
            raise UnknownColumn(f"no column {k}")
        names.append(df.columns[k] if isinstance(k, int) else k)
    return df.select(*[F.col(f"`{n}`") for n in names])


def compute(df: DataFrame, name: str, expression: str, precedence: str = "right") -> DataFrame:
    """``df`` with an arithmetic expression as a further column."""
    return df.withColumn(name, arithmetic.bind(expression, df, precedence)[0])


def join(left: DataFrame, right: DataFrame, condition: str | predicate.Predicate, left_name: str | None = None,
         right_name: str | None = None, strict: bool = False, hint: str | None = None) -> DataFrame:
    """Inner join; all columns of the left input, then all of the right one.

    Equalities between the inputs become join keys, the rest is checked on top;
    without any, Spark runs a nested loop.  A column name that both inputs have is
    given its input's name in front (``n1_name``), or refused if there is none.
    """
    both = set(left.columns) & set(right.columns)
    if both and not (left_name and right_name):
        raise AmbiguousColumn(f"both inputs have {', '.join(sorted(both))}; name the inputs")
    sides = ((left_name, left.columns), (right_name, right.columns))
    frames = [df.toDF(*[f"_{k}_{i}" for i in range(len(df.columns))]) for k, df in enumerate((left, right))]
    schemas = (left.schema, right.schema)

    def find(name: str) -> tuple[Column, T.DataType]:
        k, own = predicate.resolve_side(name, sides)
        at = schemas[k].names.index(own)
        return F.col(f"_{k}_{at}"), schemas[k][at].dataType

    on = predicate.compile_with(condition, find, strict)
    joined = (frames[0].hint(hint) if hint else frames[0]).join(frames[1], on, "inner")
    out = [F.col(f"_{k}_{i}").alias(f"{alias}_{c}" if c in both else c) for k, (alias, columns) in enumerate(sides) for i, c in enumerate(columns)]
    return joined.select(*out)


def summed(column: Column, kind: str, scale: int | None) -> Column:
    """SUM: 64 bits for Int; double precision, or exact decimals of a scale."""
    if kind == INT:
        return F.sum(column.cast("bigint"))
    if scale is None:
        return F.sum(column)
    return F.sum(column.cast(T.DecimalType(18, scale))).cast("double")


def sum_of(df: DataFrame, expression: str, precedence: str = "right", scale: int | None = None) -> DataFrame:
    """One row with ``sum``; null if there are no rows."""
    return df.agg(summed(*arithmetic.bind(expression, df, precedence), scale).alias("sum"))


def group_sum(df: DataFrame, keys: str | Sequence[str], expression: str, precedence: str = "right", scale: int | None = None) -> DataFrame:
    """``sum`` and then the keys, a row for each group; partial sums are made
    before the shuffle.  Keys are names, or a sort order's text."""
    names = predicate.sort_keys(keys) if isinstance(keys, str) else list(keys)
    for n in names:
        if n not in df.columns:
            raise UnknownColumn(f"no column {n}")
    total = summed(*arithmetic.bind(expression, df, precedence), scale)
    return df.groupBy(*names).agg(total.alias("sum")).select("sum", *names)


def distinct(df: DataFrame) -> DataFrame:
    """The rows without repetitions."""
    return df.distinct()


def all_column_order(df: DataFrame) -> list[str]:
    """All columns as sort keys: Ints, then Doubles, then Strings."""
    rank = {INT: 0, DOUBLE: 1, STRING: 2}
    return sorted(df.columns, key=lambda c: rank[kind_of(df.schema[c].dataType)])


def sort(df: DataFrame, order: str | Sequence[str]) -> DataFrame:
    """Ascending by the keys, which are names, or a sort order's text."""
    names = predicate.sort_keys(order) if isinstance(order, str) else list(order)
    for n in names:
        if n not in df.columns:
            raise UnknownColumn(f"no column {n}")
    return df.orderBy(*[F.asc(n) for n in names])


def format_rows(df: DataFrame, gap: str = "", digits: str = "%f", out: str = "line") -> DataFrame:
    """One text column: ``name:[value], name:[value]``; null prints as nothing."""
    parts: list[Column] = []
    for f in df.schema.fields:
        kind = kind_of(f.dataType)
        value = F.format_string("%d", f"`{f.name}`") if kind == INT else F.format_string(digits, F.col(f"`{f.name}`").cast("double")) if kind == DOUBLE else F.col(f"`{f.name}`").cast("string")
        value = F.when(F.col(f"`{f.name}`").isNull(), F.lit("")).otherwise(value)
        parts.append(F.concat(F.lit(f"{f.name}:{gap}["), value, F.lit("]")))
    return df.select(F.concat_ws(", ", *parts).alias(out))


def write_out(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write :func:`format_rows` as text files, all tasks at once."""
    format_rows(df).write.mode(mode).text(path)


def print_rows(df: DataFrame, to: TextIO = sys.stdout) -> int:
    """Print ``name: [value], …`` row by row, a partition in memory at a time; the
    number of rows."""
    n = 0
    for row in df.toLocalIterator():
        parts = (f"{k}: [{format(v, 'g') if isinstance(v, float) else '' if v is None else v}]" for k, v in zip(df.columns, row, strict=True))
        to.write(", ".join(parts) + "\n")
        n += 1
    return n


def order_text(df: DataFrame, order: str | Sequence[str]) -> str:
    """A sort order in words: the number of keys, and each key's place and type."""
    names = predicate.sort_keys(order) if isinstance(order, str) else list(order)
    places = [f"{df.columns.index(n)} {kind_of(df.schema[n].dataType)}" for n in names if n in df.columns]
    if len(places) < len(names):
        raise UnknownColumn(f"no column {', '.join(n for n in names if n not in df.columns)}")
    return f"{len(places)} keys: {', '.join(places)}"


def stored_positions(spark: SparkSession, path: str, out: str = "position") -> DataFrame:
    """The rows of a folder of Parquet files, each with its number (from 1) in the
    order in which they were written: by file, and in it by row.

    Only the files' row counts meet in one task, not the rows.
    """
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(bases, "_file").select(*rows.columns, (F.col("_base") + F.col("_row") + 1).alias(out))


def save_sorted(df: DataFrame, order: str | Sequence[str], path: str) -> None:
    """Sort and store as a new table of Parquet files."""
    sort(df, order).write.mode("overwrite").parquet(path)
