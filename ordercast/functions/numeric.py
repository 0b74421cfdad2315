"""Null, zero and undefined-value rules as column expressions.

A ratio that is infinite or undefined is null here. The absolute percentage error is the
one place where "no value" and "infinite" lead to different numbers, so it is written out
case by case instead of going through a null-returning division.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``; null where the denominator is 0 or either side is null."""
    return F.try_divide(numerator, denominator)


def total_or_zero(value: Column) -> Column:
    """Sum that skips nulls and is 0, not null, when nothing is left to add."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def strict_sum(value: Column) -> Column:
    """Sum that is null as soon as one member is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def strict_sd(value: Column) -> Column:
    """Sample standard deviation that is null if a member is null or there is only one."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.stddev_samp(value))


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """Three-valued choice: an unknown condition gives null rather than the ``no`` branch."""
    return F.when(condition, yes).when(~condition, no)


def abs_pct_error(forecast: Column, actual: Column, denominator: str = "actual") -> Column:
    """Absolute percentage error with its two fills: no value -> 0, infinite -> 1.

    ``denominator="actual"`` is ``|(F - A) / A|``. ``denominator="forecast"`` is ``|F - A| / F``,
    which stays negative for a negative forecast.
    """
    gap = forecast - actual
    if denominator == "actual":
        base, error = actual, F.abs(F.try_divide(gap, actual))
    elif denominator == "forecast":
        base, error = forecast, F.try_divide(F.abs(gap), forecast)
    else:
        raise ValueError(f"denominator must be 'actual' or 'forecast', not {denominator!r}")
    return (
        F.when(gap.isNull() | base.isNull(), 0.0)
        .when((base == 0) & (gap == 0), 0.0)
        .when(base == 0, 1.0)
        .otherwise(error)
    )


def normal_quantile(level: float) -> float:
    """Standard normal quantile; a scalar parameter, so it is worked out on the driver."""
    return NormalDist().inv_cdf(level)
