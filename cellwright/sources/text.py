"""Values as text, spelt alike whatever the source's types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text(c: Column, kind: T.DataType) -> Column:
    """Numbers in plain decimals where they have up to 15 digits, times without a trailing fraction, nested values as JSON."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,15)").cast("string"), r"(\.\d*?)0+\z", "$1"), r"\.\z", ".0")
        spelt = c.cast("string")
        # only large or small numbers come with an exponent; keep it where the decimal isn't the same number
        return F.when(spelt.contains("E") & (plain.try_cast("double") == c.cast("double")), plain).otherwise(spelt)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("string")
    if isinstance(kind, (T.StructType, T.MapType)) or (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType))):
        return F.to_json(c)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    return c.cast("string")


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, under its own name."""
    return df.select(*[text(df[f"`{f.name}`"], f.dataType).alias(f.name) for f in df.schema])
