"""Nanosecond time on BIGINT columns.

Spark timestamps hold microseconds, so nanoseconds stay in BIGINT columns and
buckets are computed on them; timestamps are only derived for display.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

NS_PER_S = 1_000_000_000
HALF_MINUTE = 30 * NS_PER_S
HOUR = 3600 * NS_PER_S
DAY = 24 * HOUR
MAX_I64 = 9_223_372_036_854_775_807


def int_div(a: Column, b: int) -> Column:
    """Whole division of BIGINT columns, exact where a double would not be."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def bucket_start(ns: Column, width_ns: int, origin_ns: int = 0) -> Column:
    """Start of the bucket of ``width_ns`` that holds ``ns`` (floor, also below zero)."""
    width = F.lit(width_ns).cast("bigint")
    return ns - F.pmod(ns - F.lit(origin_ns).cast("bigint"), width)


def ns_to_timestamp(ns: Column) -> Column:
    """Nanoseconds to TIMESTAMP, cut to the microsecond."""
    return F.timestamp_micros(int_div(ns - F.pmod(ns, F.lit(1000).cast("bigint")), 1000))


def bucket_ts(ns: Column, width_ns: int) -> Column:
    """Bucket start as TIMESTAMP."""
    return ns_to_timestamp(bucket_start(ns, width_ns))


def event_date(ns: Column) -> Column:
    """UTC day of ``ns`` as DATE, whatever the session time zone is."""
    days = int_div(bucket_start(ns, DAY), DAY)
    return F.date_from_unix_date(days.cast("int"))


def ntz_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, independent of the session time zone."""
    since = (ts - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("interval second")
    return (since.cast("decimal(20,6)") * 1_000_000).cast("bigint")


def epoch_ms(value: Column, data_type: T.DataType) -> Column:
    """Milliseconds since 1970 of anything that looks like a time, else NULL.

    Numbers are read as ns, us, ms or s by their size; text is read as a number
    or, when it holds a date separator, as an ISO timestamp.
    """
    def scaled(v: Column) -> Column:
        return (F.when(~is_finite(v), None)
                .when(v >= 1e17, v / 1e6).when(v >= 1e14, v / 1e3)
                .when(v >= 1e11, v).when(v >= 1e8, v * 1e3))

    if isinstance(data_type, T.NumericType):
        return scaled(value.cast("double"))
    if isinstance(data_type, T.TimestampType):
        return int_div(F.unix_micros(value), 1000).cast("double")
    if isinstance(data_type, T.TimestampNTZType):
        return int_div(ntz_micros(value), 1000).cast("double")
    if isinstance(data_type, T.DateType):
        return (F.unix_date(value).cast("double") * 86_400_000.0)
    if isinstance(data_type, T.StringType):
        dated = value.rlike("[-:T ]")
        iso = int_div(F.unix_micros(F.try_to_timestamp(value)), 1000).cast("double")
        return F.when(dated, iso).otherwise(scaled(value.try_cast("double")))
    return F.lit(None).cast("double")


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
