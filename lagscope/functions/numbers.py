"""Functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(x: Column, places: int = 2) -> Column:
    """Round the exact binary value of a double, ties to even: 0.35 is below its decimal, and goes to 0.3.

    The double is compared with the middle of its two neighbours without rounding: the product with twice the
    scale is taken in two parts, whose sum is exact.  Doubles so large that they lie further apart than the decimals
    stay as they are, infinity too; NaN stays NaN.
    """
    scale = 10.0**places
    low = F.floor(x * scale).cast("double")
    tail = x - (x * 134217729.0 - (x * 134217729.0 - x))  # the lower half of the digits
    top, twice = x - tail, 2 * scale
    product = x * twice
    error = (top * twice - product) + tail * twice
    beyond = (product - (2 * low + 1)) + error
    up = (beyond > 0) | ((beyond == 0) & (low % 2 != 0))
    small = F.abs(x) < 2.0**53 / scale  # NaN counts as larger than any number
    return F.when(small, F.when(up, low + 1).otherwise(low) / scale).otherwise(x)


def log10(x: Column) -> Column:
    """The decimal logarithm of a positive number, else null."""
    return F.when(x > 0, F.log10(x))
