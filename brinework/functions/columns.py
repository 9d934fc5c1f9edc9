"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def temporal(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def boolean(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN as null: there is one missing value."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def long_form(df: DataFrame, columns: list[str], kind: str = "double", keep: list[str] | None = None) -> DataFrame:
    """(keep..., column, value): a row for each cell of ``columns``; one scan, however many columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns))
    return df.select(*(keep or []), F.explode(pairs).alias("_p")).select(*(keep or []), "_p.column", "_p.value")


def labelled(c: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first step that ``c`` is under."""
    return reduce(lambda acc, s: acc.when(c < s[0], s[1]), steps[1:], F.when(c < steps[0][0], steps[0][1])).otherwise(last)


def row_id(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``row_id``: a hash of the declared key, or of all columns. Unlike a position it needs no sort."""
    return df.withColumn("row_id", F.xxhash64(*(order or df.columns)))
