"""The two query languages, compiled to Spark columns."""

from pyspark.sql import types as T

INT, DOUBLE, STRING = "Int", "Double", "String"


def kind_of(data_type: T.DataType) -> str:
    """The engine's type for a Spark type; dates and times compare as ISO text."""
    if isinstance(data_type, T.IntegralType):
        return INT
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return DOUBLE
    if isinstance(data_type, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return STRING
    raise TypeError(f"no engine type for {data_type.simpleString()}")
