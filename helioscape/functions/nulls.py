"""Null-aware arithmetic.  Missing stays missing until an operator says otherwise."""
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def num(value: float) -> Column:
    return F.lit(float(value))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Clip that keeps null (greatest/least alone would replace it by a bound)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, num(lo)), num(hi)))


def floor_at(x: Column, lo: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, num(lo)))


def unmask(x: Column, default: float = 0.0, lowest: float = 0.0) -> Column:
    """Missing -> default, then never below `lowest`."""
    return F.coalesce(floor_at(x, lowest), num(default))


def no_negative_zero(x: Column) -> Column:
    return x + num(0.0)


def rounded(x: Column, places: int) -> Column:
    """Half-even rounding, matching numpy."""
    return F.bround(x, places)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Applied at every scan so that no NaN reaches a comparison or an average."""
    return df.select(*[
        F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def require_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto `schema`; columns that are missing become typed nulls."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose key fields are all present."""
    return df.na.drop(subset=columns)


def positive_only(x: Column, above: float = 0.0) -> Column:
    """Sentinels at or below `above` become missing."""
    return F.when(x > num(above), x)
