"""Rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE_BITS = 60


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def round_share(share: Column, digits: int = 2) -> Column:
    """A share between 0 and 1, rounded by its exact binary value with ties to even.

    Decimal casts round the printed form of a double, which turns 0.045 (stored a little below)
    into a tie. Scaled by a power of two the share is an exact integer, so integers decide.
    """
    exact = (share * F.lit(float(2**_SCALE_BITS))).cast("bigint").cast("decimal(20,0)")
    whole = F.lit(2**_SCALE_BITS).cast("decimal(20,0)")
    half = F.lit(2 ** (_SCALE_BITS - 1)).cast("decimal(20,0)")
    scaled = exact * F.lit(10**digits).cast("decimal(6,0)")
    rest = scaled % whole
    quotient = ((scaled - rest) / whole).cast("bigint")
    up = (rest > half) | ((rest == half) & (quotient % 2 == 1))
    return (quotient + up.cast("bigint")) / F.lit(float(10**digits))


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def try_integer(value: Column) -> Column:
    return value.try_cast("int")
