"""Null-safe numeric expressions (ANSI mode stays on)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str, default: float | None = 0.0) -> Column:
    """Double value of ``c``; unparsable text, NULL and NaN become ``default``.

    Java also parses ``1d``, ``1f`` and hex floats, which are not numbers here.
    """
    c = _col(c)
    java_only = c.cast("string").rlike(r"(?i)([0-9.][df]|x.*)\s*$")
    parsed = F.when(~F.coalesce(java_only, F.lit(False)), c.try_cast("double"))
    value = F.nanvl(parsed, F.lit(None).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def plain(c: Column | str, default: float = 0.0) -> Column:
    """``number`` for columns already numeric: no text check in the hot path."""
    value = F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))
    return F.coalesce(value, F.lit(float(default)))


def rate(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is not positive or missing."""
    return F.coalesce(F.when(denominator > 0, F.try_divide(numerator, denominator)), F.lit(0.0))


def clipped_int(c: Column, low: int, high: int = 100) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))).cast("int")


def flag(condition: Column, yes, no) -> Column:
    """``yes`` where the condition holds; NULL conditions count as false."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(yes)).otherwise(F.lit(no))


def scaled(c: Column, low: float | None, high: float | None) -> Column:
    """Min-max scaling against given bounds; a constant or empty column gives 0."""
    if low is None or high is None or low == high:
        return F.lit(0.0)
    return (c - F.lit(float(low))) / F.lit(float(high) - float(low))
