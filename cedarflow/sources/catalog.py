"""Text catalogs: blocks of a relation's name, its file, and its attributes.

    BEGIN
    region
    region.tbl
    r_regionkey Int
    r_name String
    END
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from cedarflow.errors import SyntaxProblem, UnknownColumn

TYPES = {"Int": T.IntegerType(), "Double": T.DoubleType(), "String": T.StringType()}


@dataclass(frozen=True)
class Relation:
    name: str
    file: str
    schema: T.StructType


def schema_of(attributes: list[tuple[str, str]]) -> T.StructType:
    """A schema from names and types (Int, Double, String)."""
    fields = []
    for name, kind in attributes:
        if kind not in TYPES:
            raise SyntaxProblem(f"{name}: no type {kind}")
        fields.append(T.StructField(name, TYPES[kind]))
    return T.StructType(fields)


def parse_catalog(text: str) -> dict[str, Relation]:
    found: dict[str, Relation] = {}
    words = text.split()
    i = 0
    while i < len(words):
        if words[i] != "BEGIN":
            raise SyntaxProblem(f"expected BEGIN, found {words[i]}")
        try:
            end = words.index("END", i)
        except ValueError:
            raise SyntaxProblem("a BEGIN without END") from None
        block = words[i + 1 : end]
        if len(block) < 4 or len(block) % 2:
            raise SyntaxProblem(f"incomplete relation {' '.join(block[:1])}")
        relation = Relation(block[0], block[1], schema_of(list(zip(block[2::2], block[3::2], strict=True))))
        found.setdefault(relation.name, relation)
        i = end + 1
    return found


def text_of(path: str, spark: SparkSession | None = None) -> str:
    """A small text file: of this machine, or with a session of any store."""
    if spark is not None:
        return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    with open(path, encoding="utf-8") as f:
        return f.read()


def load_catalog(path: str, spark: SparkSession | None = None) -> dict[str, Relation]:
    return parse_catalog(text_of(path, spark))


def relation_of(catalog: dict[str, Relation], name: str) -> Relation:
    if name not in catalog:
        raise UnknownColumn(f"the catalog has no relation {name}")
    return catalog[name]


def rows_of(spark: SparkSession, schema: T.StructType, lines: list[str]) -> DataFrame:
    """Rows composed from delimited strings, as of a very small file."""
    make = {T.IntegerType(): int, T.DoubleType(): float, T.StringType(): str}
    data = [Row(*[make[f.dataType](v) for f, v in zip(schema.fields, line.rstrip("\n").split("|"), strict=False)]) for line in lines]
    return spark.createDataFrame(data, schema)
