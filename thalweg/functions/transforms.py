"""Rescaling and the eight resistance transforms.

All are plain expressions over a value, its group's least and greatest value, and a shape; groups are windows or
aggregates chosen by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

#: The ids of the transforms.
NAMES = {0: "identity", 1: "ricker", 2: "reverse ricker", 3: "inverse ricker", 4: "reverse inverse ricker", 5: "monomolecular", 6: "reverse monomolecular", 7: "inverse monomolecular", 8: "reverse inverse monomolecular"}


def rescale(x: Column, low: Column, high: Column, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    """x moved linearly from [low, high] to [to_low, to_high]; null where low = high."""
    if not (isinstance(to_low, (int, float)) and isinstance(to_high, (int, float))):
        raise ValueError("bounds have to be numbers")
    if to_high <= to_low:
        raise ValueError("the upper bound has to exceed the lower")
    return F.try_divide(x - low, high - low) * float(to_high - to_low) + float(to_low)


def rescale_over(x: Column, window: WindowSpec, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    return rescale(x, F.min(x).over(window), F.max(x).over(window), to_low, to_high)


def rescale_columns(df: DataFrame, columns: list[str], to_low: float = 0.0, to_high: float = 1.0) -> DataFrame:
    """Each column over its whole range: one aggregate of two numbers a column, joined back as a single row."""
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    if df.isEmpty():
        raise ValueError("no rows to rescale")
    bounds = df.agg(*[f(c).alias(f"__{n}_{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))])
    done = {c: rescale(F.col(c), F.col(f"__low_{i}"), F.col(f"__high_{i}"), to_low, to_high) for i, c in enumerate(columns)}
    return df.crossJoin(F.broadcast(bounds)).withColumns(done).select(*df.columns)


def transform(x: Column, low: Column, high: Column, transform_id: Column, shape: Column, ceiling: float = 1.0) -> Column:
    """The transform of given id and shape, before the final rescaling. Shape 0, or id 0, is the identity.

    A reversal reflects x within [low, high]; reversing an inverse reflects values within their own range, which the
    rescaling that follows turns into the plain curve (ids 4 and 1 agree after it).
    """
    t, c = transform_id, F.lit(float(ceiling))
    reversed_x = F.when(t.isin(2, 6, 8), low + high - x).otherwise(x)
    fall = F.exp(-F.try_divide(reversed_x, shape))
    hump = c * reversed_x * fall
    return (
        F.when((t == 0) | (shape == 0), x)
        .when(t.isin(1, 2, 4), hump + 1)
        .when(t == 3, -hump - 1)
        .when(t.isin(5, 6), c * (1 - fall) + 1)
        .when(t.isin(7, 8), c * fall + 1)
        .otherwise(F.raise_error(F.lit("unknown transform")).cast("double"))
    )


def check_shape(shape) -> float:
    if isinstance(shape, bool) or not isinstance(shape, (int, float)) or shape <= 0:
        raise ValueError("a shape has to be a positive number")
    return float(shape)


def fill_zeros(x: Column, window: WindowSpec) -> Column:
    """Zeros replaced by the least positive value of the window."""
    return F.when(x == 0, F.min(F.when(x > 0, x)).over(window)).otherwise(x)


def minmax_nonzero(df: DataFrame, column: str, window: WindowSpec) -> DataFrame:
    """The column in [0, 1] over the window, zeros then replaced by the least positive value."""
    scaled = df.withColumn(column, rescale_over(F.col(column), window))
    return scaled.withColumn(column, fill_zeros(F.col(column), window))


def masked_minmax(x: Column, mask: Column, window: WindowSpec) -> Column:
    """[0, 1] over the values under the mask; others, and all if those are constant, stay."""
    inside = F.when(mask, x)
    low, high = F.min(inside).over(window), F.max(inside).over(window)
    return F.when(mask & (high > low), rescale(x, low, high)).otherwise(x)


def minmax_stored(df: DataFrame, value: str = "value") -> DataFrame:
    """The stored entries of a sparse matrix, a row each, in [0, 1] over their whole range; absent entries count nowhere.

    Entries that are all equal stay. Null entries stay null.
    """
    bounds = df.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    scaled = F.when(F.col("__high") > F.col("__low"), rescale(F.col(value), F.col("__low"), F.col("__high"))).otherwise(F.col(value))
    return df.crossJoin(F.broadcast(bounds)).withColumn(value, scaled).select(*df.columns)


def zscore(x: Column, window: WindowSpec) -> Column:
    return F.try_divide(x - F.avg(x).over(window), F.stddev_pop(x).over(window))
