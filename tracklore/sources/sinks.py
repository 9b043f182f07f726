"""Result rows as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows_as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row; NULLs kept, dates, times and decimals as text."""

    def printable(field: T.StructField):
        c = F.col(field.name)
        kinds = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
        return (c.cast("string") if isinstance(field.dataType, kinds) else c).alias(field.name)

    row = F.struct(*[printable(f) for f in df.schema.fields])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))
