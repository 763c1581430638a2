"""Column functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half(x: Column, places: int) -> Column:
    """x rounded as SQL's engine does: the product with 10^places to the next whole number, halves away from zero.

    Spark's round takes the decimal digits that a double prints as: 0.00015 becomes 0.0002, while its product with 10,000 lies below 1.5.
    """
    of = 10.0**places
    y = F.abs(x * of)
    whole = F.rint(y)  # to the even one on a half
    return F.when(y == float("inf"), x).otherwise(F.signum(x) * (whole + (y - whole == 0.5).cast("double")) / of)
