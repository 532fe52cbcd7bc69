"""Stored tables: heaps, and tables kept sorted by a key.

A table is a folder with Parquet files and a small JSON file that says what it
is.  The JSON file is never changed: each state is a file with the next number, put
in place by one rename, and the highest number counts.  So a write that fails leaves
the table as it was, and two writers cannot both make the same state.

A sorted table collects new rows and stores them when it is read or closed: they
are dealt by ranges of the key, sorted, and written as a further sorted run, so a few
new rows cost what they are, not what the table is.  Beyond ``MOST_RUNS`` runs they are
rewritten as one.  Files of earlier states stay for those who still read them, until
``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cedarflow.errors import EngineError, UnknownColumn
from cedarflow.functions import arithmetic, predicate
from cedarflow.operators import relational
from cedarflow.sources.catalog import Relation, load_catalog, relation_of, text_of
from cedarflow.sources.delimited import read_tbl

META = "table-{:09d}.json"
MOST_RUNS = 8


class Store:
    """Small files and folders in any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Put a new file in place; one that is there already is not replaced."""
        temp = self._path(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(temp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(temp, self._path(name)):
            self.fs.delete(temp, False)
            raise EngineError(f"{self.root}: another writer has made {name}")

    def names(self) -> list[str]:
        root = self._path("")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(root)) if self.fs.exists(root) else []

    def states(self) -> list[str]:
        """The files that say what a table is, the one that counts last."""
        return [n for n in self.names() if n.startswith("table-") and n.endswith(".json")]

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Table:
    """What both kinds of table share."""

    spark: SparkSession
    path: str
    meta: dict
    staged: list[DataFrame] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return self.meta["kind"]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.meta["schema"])

    def _data(self) -> str:
        return f"{self.path}/{self.meta['data']}"

    def load(self, tbl_path: str, lenient: bool = False) -> None:
        """Append the rows of a delimited file."""
        self.append(read_tbl(self.spark, tbl_path, self.schema, lenient))

    def add(self, rows: Sequence[tuple]) -> None:
        """Append a few rows, together."""
        self.append(self.spark.createDataFrame([Row(*r) for r in rows], self.schema))

    def append(self, df: DataFrame) -> None:
        raise NotImplementedError

    def scan(self, condition: str | None = None, strict: bool = False) -> DataFrame:
        raise NotImplementedError

    def rows(self, condition: str | None = None) -> Iterator[Row]:
        """A cursor over the rows; it begins anew at every call."""
        return self.scan(condition).toLocalIterator()

    def close(self) -> None:
        """Nothing is pending in a heap."""

    def _write_meta(self) -> None:
        self.meta = self.meta | {"version": self.meta["version"] + 1}
        Store(self.spark, self.path).write(META.format(self.meta["version"]), json.dumps(self.meta))

    def vacuum(self) -> None:
        """Delete what only earlier states need; nobody may be reading them."""
        store, own = Store(self.spark, self.path), {META.format(self.meta["version"]), self.meta["data"], *self.meta["runs"]}
        for name in store.names():
            if name not in own:
                store.delete(name)


class HeapTable(Table):
    """Rows in no order; appending adds files."""

    def append(self, df: DataFrame) -> None:
        df.select(*self.schema.names).write.mode("append").parquet(self._data())

    def scan(self, condition: str | None = None, strict: bool = False) -> DataFrame:
        if not Store(self.spark, self.path).exists(self.meta["data"]):
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(self.schema).parquet(self._data())
        return relational.select(df, condition, strict) if condition else df


class SortedTable(Table):
    """Rows in the order of the keys; new rows wait for the next read or close."""

    @property
    def keys(self) -> list[str]:
        return self.meta["keys"]

    def append(self, df: DataFrame) -> None:
        self.staged.append(df.select(*self.schema.names))

    def _run(self, df: DataFrame, earlier: list[str]) -> None:
        """Store rows as a sorted run behind the earlier ones, and make it count."""
        new = f"run-{uuid.uuid4().hex}"
        df.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/{new}")
        self.meta = self.meta | {"runs": [*earlier, new]}
        self._write_meta()

    def _stored(self) -> DataFrame:
        if not self.meta["runs"]:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r}" for r in self.meta["runs"]])

    def merge(self) -> None:
        """Store the rows that wait; with too many runs, rewrite them as one."""
        if self.staged:
            self._run(reduce(DataFrame.unionByName, self.staged), self.meta["runs"])
            self.staged.clear()
        if len(self.meta["runs"]) > MOST_RUNS:
            self.compact()

    def compact(self) -> None:
        """Rewrite all runs as one."""
        if len(self.meta["runs"]) > 1:
            self._run(self._stored(), [])

    def _files(self) -> DataFrame:
        self.merge()
        return self._stored()

    def scan(self, condition: str | None = None, strict: bool = False) -> DataFrame:
        """In the order of the keys.  A predicate reaches the Parquet files, whose
        statistics skip row groups, the rows being sorted."""
        df = self._files()
        return (relational.select(df, condition, strict) if condition else df).orderBy(*self.keys)

    def lookup(self, condition: str, strict: bool = False) -> DataFrame:
        """As :meth:`scan`, in no promised order and so without a shuffle."""
        return relational.select(self._files(), condition, strict)

    def key_prefix(self, condition: str) -> list[str]:
        """The leading keys that the predicate sets equal to values."""
        fixed = set()
        for clause in predicate.parse(condition).clauses:
            c = clause[0]
            if len(clause) == 1 and c.op == "=" and c.left.is_name != c.right.is_name:
                fixed.add(c.left.value if c.left.is_name else c.right.value)
        prefix = []
        for k in self.keys:
            if k not in fixed:
                break
            prefix.append(k)
        return prefix

    def close(self) -> None:
        self.merge()


def create(spark: SparkSession, path: str, schema: T.StructType, kind: str = "heap", keys: str | Sequence[str] = ()) -> HeapTable | SortedTable:
    """A new, empty table; what was at ``path`` goes.  ``tree`` is not built."""
    if kind == "tree":
        raise NotImplementedError("tree tables are not supported")
    if kind not in ("heap", "sorted"):
        raise EngineError(f"no such kind of table: {kind}")
    names = predicate.sort_keys(keys) if isinstance(keys, str) else list(keys)
    if kind == "sorted" and not names:
        raise EngineError("a sorted table needs keys")
    for k in names:
        if k not in schema.names:
            raise UnknownColumn(f"no column {k}")
    Store(spark, path).delete("")
    meta = {"kind": kind, "keys": names, "data": "data-0", "runs": [], "version": -1, "schema": json.loads(schema.json())}
    table = (HeapTable if kind == "heap" else SortedTable)(spark, path.rstrip("/"), meta)
    table._write_meta()
    return table


def open_table(spark: SparkSession, path: str) -> HeapTable | SortedTable:
    """The table at ``path``, of the kind it was created as."""
    store = Store(spark, path)
    states = store.states()
    if not states:
        raise EngineError(f"no table at {path}")
    meta = json.loads(store.read(states[-1]))
    return (HeapTable if meta["kind"] == "heap" else SortedTable)(spark, path.rstrip("/"), meta)


@dataclass(frozen=True)
class Settings:
    """Where the catalog, the tables and the delimited files are."""

    catalog: str
    tables: str
    files: str


def read_settings(path: str, spark: SparkSession | None = None) -> Settings:
    """Three lines: catalog, folder of tables (may be empty), folder of files.
    With a session, ``path`` may be in any store that Spark reads."""
    lines = [x.strip() for x in text_of(path, spark).split("\n")]
    if len(lines) < 3 or not lines[0]:
        raise EngineError(f"{path} does not have three lines")
    return Settings(*lines[:3])


@dataclass(frozen=True)
class Handle:
    """A relation of the catalog with its places, and its languages bound."""

    relation: Relation
    settings: Settings

    @property
    def table_path(self) -> str:
        return f"{self.settings.tables.rstrip('/') or '.'}/{self.relation.name}"

    @property
    def file_path(self) -> str:
        return f"{self.settings.files.rstrip('/')}/{self.relation.file}"

    def read(self, spark: SparkSession, lenient: bool = False) -> DataFrame:
        return read_tbl(spark, self.file_path, self.relation.schema, lenient)

    def predicate(self, df: DataFrame, text: str):
        return predicate.bind(text, df)

    def expression(self, df: DataFrame, text: str):
        return arithmetic.bind(text, df)

    def order(self, text: str) -> list[str]:
        return predicate.sort_keys(text)


def handle(settings: Settings, name: str, spark: SparkSession | None = None) -> Handle:
    return Handle(relation_of(load_catalog(settings.catalog, spark), name), settings)


def filter_file(spark: SparkSession, path: str, schema: T.StructType, condition: str) -> DataFrame:
    """A predicate over a delimited file, without a table."""
    return relational.select(read_tbl(spark, path, schema), condition)


def count_distinct(df: DataFrame, approximate: bool = False) -> dict[str, int]:
    """Rows and distinct values by column, for the estimator, in one pass.  Exact
    counts expand every row by the number of columns; ``approximate`` ones (within
    some 2 %) need a small sketch for each column and no expansion."""
    count = (lambda c: F.approx_count_distinct(c, 0.02)) if approximate else F.countDistinct
    row = df.agg(F.count("*").alias("_rows"), *[count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return {k: int(v) for k, v in row.asDict().items()}
