"""Missing values, rounding and order-independent sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, INTEGRAL)


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, FRACTIONAL)


def is_number(data_type: T.DataType) -> bool:
    return is_integral(data_type) or is_fractional(data_type)


def is_datetime(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, so it becomes NULL once, at the entry of an operator."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats}) if floats else df


def exact_sum(value: Column | str, scale: int = 4) -> Column:
    """Sum on a fixed number of decimals, as a double.

    A double sum depends on the order in which partitions arrive, so a retried task may change the
    last digits. Counting in units of 10**-scale is exact, and decimal(38) does not overflow.
    """
    value = F.col(value) if isinstance(value, str) else value
    units = F.rint(value * F.lit(float(10**scale))).cast("bigint").cast("decimal(18,0)")
    return (F.sum(units) / F.lit(10**scale)).cast("double")


def exact_mean(value: Column | str, scale: int = 4) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.try_divide(exact_sum(value, scale), F.count(value).cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division where zero gives NULL rather than infinity."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100.0
