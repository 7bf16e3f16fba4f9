"""Exact arithmetic and printed forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 8) -> Column:
    """x as SQL engines round doubles: the product with 10^digits to the nearest whole number, halves away from 0; F.round takes x's shortest decimal form."""
    x, unit = x.cast("double"), 10.0**digits
    near = F.rint(x * unit)
    off = x * unit - near
    whole = F.when((off == 0.5) & (x > 0), near + 1).when((off == -0.5) & (x < 0), near - 1).otherwise(near)
    return F.when(F.abs(x * unit) == float("inf"), x).otherwise(whole / unit)


def ratio(x: Column, y: Column) -> Column:
    """x / y as doubles; null where y is 0."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def pairs_of(x: Column) -> Column:
    """x (x - 1) / 2 in whole numbers."""
    return F.shiftright((x * (x - 1)).cast("long"), 1)


def truncated_ratio(n: str, d: str) -> Column:
    """n / d of two decimal expressions with 9 decimals, cut toward zero; null where d is 0."""
    return F.expr(f"cast((1000000000BD * ({n})) div nullif({d}, 0BD) as double) / 1e9D")
