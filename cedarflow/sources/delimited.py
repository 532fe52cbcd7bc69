"""Files of ``|``-terminated fields, one row a line, without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tbl(spark: SparkSession, path: str, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """Rows of the file or files at ``path``.

    Quotes are ordinary characters and an empty String stays empty.  Numbers that
    do not parse are null; with ``lenient`` their longest numeric beginning counts,
    and 0 if there is none.
    """
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])) if lenient else spark.read.schema(schema)
    df = raw.csv(path, sep="|", quote="", escape="", mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif lenient:
            number = r"^\s*([+-]?\d+)" if isinstance(f.dataType, T.IntegerType) else r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
            c = F.coalesce(F.regexp_extract(c, number, 1).try_cast(f.dataType), F.lit(0).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def write_tbl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write with a ``|`` behind every field; null is written as nothing.

    The format has no way to write ``|`` or a line end inside a value; the write fails
    at the first such value.
    """
    def field(c: str):
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        if not isinstance(df.schema[c].dataType, T.StringType):
            return F.concat(value, F.lit("|"))
        refused = F.raise_error(F.concat(F.lit(f"{c}: a delimited file cannot hold "), value)).cast("string")
        return F.when(value.rlike(r"[|\n\r]"), refused).otherwise(F.concat(value, F.lit("|")))

    fields = [field(c) for c in df.columns]
    df.select(F.concat(*fields).alias("line")).write.mode(mode).text(path)
