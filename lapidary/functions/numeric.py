"""Rounding and quantile rules, as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: str, digits: int = 0) -> str:
    """Rounds halves towards plus infinity: -2.5 gives -2."""
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"(CAST(FLOOR(({x}) * {scale} + CAST(0.5 AS DOUBLE)) AS DOUBLE) / {scale})"


def rounded(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def sorted_values(x: Column) -> Column:
    """All non-null values of a group, ascending. For groups of bounded size, such as one design's stones."""
    return F.array_sort(F.collect_list(x))


def quantile_inner(values: Column, p: float) -> Column:
    """Element floor(p * (n - 1)) of a sorted array."""
    return F.get(values, F.floor(F.lit(p) * (F.size(values) - 1)).cast("int"))


def quantile_outer(values: Column, p: float) -> Column:
    """Element min(n - 1, floor(p * n)) of a sorted array."""
    return F.get(values, F.least(F.size(values) - 1, F.floor(F.lit(p) * F.size(values)).cast("int")))


def upper_median(values: Column) -> Column:
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def bin_of(x: str, edges: list[float]) -> str:
    """Number of the left-closed bin between edges; 0 lies below the first."""
    return "(" + " + ".join(f"CASE WHEN {x} >= CAST({e} AS DOUBLE) THEN 1 ELSE 0 END" for e in edges) + ")"
