"""Output conventions shared by every registered query and its oracle:
doubles rounded to 9 places, arrays joined with ',', small ints widened to INT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def for_check(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 9)
        elif isinstance(t, (T.ShortType, T.ByteType)):
            c = c.cast("int")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            c = F.array_join(c, ",")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: F.round(x.cast("double"), 9).cast("string")), ",")
        out.append(c.alias(f.name))
    return df.select(*out)
