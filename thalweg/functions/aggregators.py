"""The twelve named aggregators as Column builders, for use inside any groupBy().agg() or window.

Nulls are skipped; NaN should be turned into null on the way in (sources do). Errors of domain are raised when rows are
aggregated, with a message that names the aggregator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _guarded(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def geometric(x: Column) -> Column:
    """exp(mean(ln x)); a zero makes it 0, a negative value is an error."""
    logs = F.avg(F.when(x > 0, F.ln(F.when(x > 0, x))))
    return _guarded(F.coalesce(F.min(x) < 0, F.lit(False)), "GEOM of a negative value", F.when(F.min(x) == 0, 0.0).otherwise(F.exp(logs)))


def harmonic(x: Column) -> Column:
    """n / sum(1/x); zero or negative values are an error."""
    return _guarded(F.coalesce(F.min(x) <= 0, F.lit(False)), "HARM of a value that is not positive", F.count(x) / F.sum(F.try_divide(F.lit(1.0), x)))


def adjusted_harmonic(x: Column) -> Column:
    """Harmonic mean of the positive values, scaled by their share, with the count reduced by the others; 0 if none."""
    positive, n = F.count_if(x > 0), F.count(x)
    inverse = F.sum(F.when(x > 0, F.try_divide(F.lit(1.0), x)))
    return F.when(positive == 0, 0.0).otherwise((2 * positive - n) / inverse * positive / n)


def variation(x: Column) -> Column:
    return F.when(F.avg(x) == 0, 0.0).otherwise(F.try_divide(F.stddev_pop(x), F.avg(x)))


def first(x: Column, order: Column | None = None) -> Column:
    """The value of least order. Without an order, the least value, so that the result does not depend on the plan."""
    return F.min_by(x, order if order is not None else x)


AGGREGATORS: dict[str, Callable[..., Column]] = {
    "ARITH": F.avg,
    "GEOM": geometric,
    "HARM": harmonic,
    "ADJHARM": adjusted_harmonic,
    "MEDIAN": F.median,
    "MAX": F.max,
    "MIN": F.min,
    "SD": F.stddev_pop,
    "VAR": F.var_pop,
    "CV": variation,
    "FIRST": first,
    "SUM": F.sum,
}


def aggregate(method: str, column: str | Column, order: Column | None = None) -> Column:
    """Looks an aggregator up by name."""
    if not isinstance(method, str):
        raise TypeError("the aggregator's name has to be a string")
    if method not in AGGREGATORS:
        raise ValueError(f"unknown aggregator {method!r}; known: {', '.join(AGGREGATORS)}")
    x = F.col(column) if isinstance(column, str) else column
    return first(x, order) if method == "FIRST" else AGGREGATORS[method](x)
