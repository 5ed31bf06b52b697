"""Rounding and number helpers that follow the reference results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from .timeutil import is_finite


def round_to(x: Column, digits: int) -> Column:
    """Rounds a double half away from zero on the scaled value.

    Spark's ``round`` works on the decimal text of the double and gives another
    last digit for values such as 1.005.
    """
    scale = float(10 ** digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale


def to_number(value: Column, data_type: T.DataType) -> Column:
    """Finite double of a number or number-like text, else NULL."""
    if isinstance(data_type, T.NumericType):
        number = value.cast("double")
    elif isinstance(data_type, T.StringType):
        number = value.try_cast("double")
    else:
        return F.lit(None).cast("double")
    return F.when(is_finite(number), number)
