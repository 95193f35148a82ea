"""Numeric helpers with one fixed rounding rule (half up, on the scaled value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half up: floor(x*10^k + 0.5) / 10^k."""
    if digits == 0:
        return F.floor(x + F.lit(0.5)).cast("double")
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def settle(x: Column, digits: int) -> Column:
    """Round a sum of floats: first to 9 digits, so the order of summing cannot move a tie."""
    return half_up(half_up(x, 9), digits)


def is_finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite; never null itself."""
    inf = F.lit(float("inf"))
    return F.coalesce(~F.isnan(x) & (x < inf) & (x > -inf), F.lit(False))


def or_else(x: Column, y: Column) -> Column:
    """x unless it is null or zero."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), y)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def pick(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    """First value whose condition holds."""
    cond, value = pairs[0]
    chain = F.when(cond, value)
    for cond, value in pairs[1:]:
        chain = chain.when(cond, value)
    return chain.otherwise(default)
