"""Rounding that decides ties on the exact binary value, half to even."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where it would appear several times.

    Inside higher-order functions and branches Spark does not share common subexpressions.
    """
    return F.get(F.transform(F.array(value), body), 0)


def round_exact(value: Column, digits: int = 6) -> Column:
    """Round a double between -1e6 and 1e6 to ``digits`` (at most 6) decimals.

    ``bround`` looks at the shortest decimal text of the double, so 1/640 = 0.0015625 is a tie for it
    although the stored binary value lies beside the tie. Here the value is split in two halves whose
    products with 10^digits are exact, and the distance to the candidate is compared without error.
    """
    scale = float(10**digits)
    value = value.cast("double")
    spread = value * F.lit(float(2**21 + 1))
    high = spread - (spread - value)
    low = (value - high) * F.lit(scale)
    high = high * F.lit(scale)
    nearest = F.rint(value * F.lit(scale))
    above = (high - nearest - F.lit(0.5)) + low
    below = (high - nearest + F.lit(0.5)) + low
    odd = F.pmod(nearest, F.lit(2.0)) == 1.0
    whole = (
        F.when((above > 0) | ((above == 0) & odd), nearest + 1.0)
        .when((below < 0) | ((below == 0) & odd), nearest - 1.0)
        .otherwise(nearest)
    )
    # Adding zero turns -0.0 into 0.0.
    return whole / F.lit(scale) + F.lit(0.0)


def clamp(value: Column, low: Column, high: Column) -> Column:
    """The value within bounds; null stays null, which ``greatest`` and ``least`` would skip."""
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def clamp01(value: Column) -> Column:
    return clamp(value, F.lit(0.0), F.lit(1.0))
