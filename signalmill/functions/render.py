"""Rendering of result values as JSON-safe columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .jsontext import non_finite_text
from .timeutil import DAY, int_div, is_finite

_DAY_US = DAY // 1000
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def render_values(df: DataFrame) -> DataFrame:
    """Text for the types JSON has no place for.

    Wide integers and decimals become text, binary becomes hex, timestamps an
    ISO text with nine fraction digits, non-finite doubles ``inf``/``NaN``
    (only in columns kept as text), everything else stays.
    """
    out = []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, T.BinaryType):
            c = F.lower(F.hex(c))
        elif isinstance(t, T.TimestampType):
            c = F.concat(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), _STAMP), F.lit("000Z"))
        elif isinstance(t, T.TimestampNTZType):
            c = F.concat(F.date_format(c, _STAMP), F.lit("000Z"))
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.DecimalType):
            c = c.cast("string")
        elif isinstance(t, T.DayTimeIntervalType):
            us = (c.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")
            c = F.concat(F.lit("0mo "), int_div(us, _DAY_US), F.lit("d "), (us - int_div(us, _DAY_US) * _DAY_US) * 1000, F.lit("ns"))
        elif isinstance(t, T.YearMonthIntervalType):
            c = F.concat(c.cast("interval month").cast("int"), F.lit("mo 0d 0ns"))
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.when(c.isNull() | is_finite(c), c.cast("string")).otherwise(non_finite_text(c))
        out.append(c.alias(field.name))
    return df.select(*out)
