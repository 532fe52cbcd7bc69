"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is handed to numpy in blocks of about this many code points.
BLOCK_CHARS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a folder of this machine is made, but only for a
    local master, whose executors are the driver; a cluster without one is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if made:
        return made.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{master}: set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cedarflow-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables made in the :func:`settled` calls under way, innermost last.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a
    lost executor costs nothing that was written."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    for paths in _MADE.get()[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that no later plan reads."""
    files = df._jdf.inputFiles()
    if len(files):  # all of them lie in one folder
        remove_path(df.sparkSession, str(files[0]).rsplit("/", 1)[0])


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df``, dealt by a hash of the columns ``by`` if it is read from fewer files
    than there are cores; Python work would keep few of them busy otherwise.

    A file that holds one row group is one task's, however many splits it has.
    Tables of many files, and frames that come from no files, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())
    return df.repartition(2 * cores, F.xxhash64(*by)) if 0 < files < cores else df


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, as a table; the tables that were made on the way, and
    that only it read, are deleted."""
    made: list[str] = []
    token = _MADE.set((*_MADE.get(), made))
    try:
        out = make()
    finally:
        _MADE.reset(token)
    table = materialise(out, name)
    for path in made:
        remove_path(out.sparkSession, path)
    return table


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 * BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


def with_own_columns(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over ``docs`` with every column but doc_id, text, lang and n_chars
    under a name that cannot clash; the result has the columns of ``docs``."""
    plain = ("doc_id", "text", "lang", "n_chars")
    names = {c: c if c in plain else f"_own_{i}" for i, c in enumerate(docs.columns)}
    out = run(docs.toDF(*names.values()))
    return out.select(*[F.col(f"`{new}`").alias(old) for old, new in names.items()])
