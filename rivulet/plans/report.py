"""Report form of query results.

Library operators return natural Spark types.  Results handed to the query
catalog are put in a form that compares exactly across engines: timestamps as
``yyyy-MM-dd HH:mm:ss.SSSSSS`` strings, doubles rounded to 6 decimals (sums run
in different orders on different engines), integers widened to 64 bits.  The
DuckDB oracles in the catalog apply the same conventions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DIGITS = 6


def report(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TS_MICROS)
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)
