"""Chart-ready shapes of any result frame.

Which columns a shape uses is decided at plan time, from one aggregate over all
rows; the rows themselves stay a DataFrame.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.jsontext import key_values
from ..functions.numbers import to_number
from ..functions.timeutil import epoch_ms

# Fixed value: column names that read as a time.
TIME_NAME = re.compile(r"^(ts|t_|_?ts$|time|timestamp|when|date)", re.IGNORECASE)
MAX_LINES, MAX_SCATTER = 8, 4


class Shape(NamedTuple):
    x: str
    values: list[str]
    rows: DataFrame
    left_out: list[str] = []  # columns that could be values too, beyond the number asked for


def _col(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`")


def _number(df: DataFrame, name: str) -> Column:
    return to_number(_col(df, name), df.schema[name].dataType)


def _time(df: DataFrame, name: str) -> Column:
    return epoch_ms(_col(df, name), df.schema[name].dataType)


class Facts(NamedTuple):
    """Row count; numeric, non-NULL and (where asked for) time values per column."""

    n: int
    numeric: dict[str, int]
    present: dict[str, int]
    times: dict[str, int]


def _facts(df: DataFrame, times: bool = False) -> Facts:
    counted = {"num": _number, "any": _col} | ({"time": _time} if times else {})
    one = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count(value(df, c)).alias(f"{kind}{i}") for kind, value in counted.items() for i, c in enumerate(df.columns)]).first()
    return Facts(one["n"], *[{c: one[f"{kind}{i}"] for i, c in enumerate(df.columns)} if kind in counted else {}
                             for kind in ("num", "any", "time")])


def _named_first(columns: list[str]) -> str | None:
    return next((c for c in columns if TIME_NAME.match(c)), columns[0] if columns else None)


def line(df: DataFrame, most: int | None = MAX_LINES) -> Shape | None:
    """A time column and up to ``most`` (None: all) numeric columns that are not times themselves, in time order.

    In a time column every value that is not NULL reads as a time. One aggregate over the input decides; it is not read again.
    """
    n, numeric, present, counts = _facts(df, times=True)
    times = [c for c in df.columns if present[c] == counts[c] > 0]
    x = _named_first(times)
    if n < 2 or x is None:
        return None
    found = [c for c in df.columns if c != x and numeric[c] > 0 and c not in times]
    series = found[:most]
    if not series or counts[x] < 2:
        return None
    rows = df.select(_time(df, x).alias("x"), *[_number(df, c).alias(c) for c in series]).where(F.col("x").isNotNull())
    return Shape(x, series, rows.orderBy("x"), found[len(series):])


def scatter(df: DataFrame, most: int | None = MAX_SCATTER) -> Shape | None:
    """An x column and up to ``most`` (None: all) numeric columns; x below 1e11 is taken as it is, else as a time."""
    n, numeric, *_ = _facts(df)
    x = _named_first([c for c in df.columns if numeric[c] > 0])
    if n < 2 or x is None:
        return None
    found = [c for c in df.columns if c != x and numeric[c] > 0]
    ys = found[:most]
    if not ys:
        return None
    raw = _number(df, x)
    at = F.when(raw < 1e11, raw).otherwise(_time(df, x))
    rows = df.select(at.alias("x"), *[_number(df, c).alias(c) for c in ys]).where(F.col("x").isNotNull())
    return Shape(x, ys, rows, found[len(ys):]) if len(rows.take(2)) == 2 else None


def bar(df: DataFrame) -> Shape | None:
    """The first column without numbers as label, numeric columns as values."""
    n, numeric, present, _ = _facts(df)
    values = [c for c in df.columns if numeric[c] > 0]
    if n < 1 or not values:
        return None
    label = next((c for c in df.columns if numeric[c] == 0 and present[c] > 0), df.columns[0])
    return Shape(label, values, df.select(
        F.coalesce(_col(df, label).cast("string"), F.lit("")).alias("label"), *[_number(df, c).alias(c) for c in values]))


def value_histogram(df: DataFrame, column: str | None = None) -> DataFrame:
    """Equal-width bins of a numeric column (the first one by default), empty bins included.

    The number of bins follows Sturges' rule between 5 and 40. No rows when
    there are fewer than three values or they are all equal.
    """
    if column is None:
        _, numeric, *_ = _facts(df)
        column = next(c for c in df.columns if numeric[c] > 0)
    values = df.select(_number(df, column).alias("v")).where(F.col("v").isNotNull())
    stats = (values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
             .where((F.col("n") >= 3) & (F.col("lo") < F.col("hi")))
             .withColumn("k", F.least(F.greatest(F.ceil(F.log2("n")) + 1, F.lit(5)), F.lit(40)).cast("int"))
             .withColumn("w", (F.col("hi") - F.col("lo")) / F.col("k")))
    binned = values.withColumn("_s", stats.select(F.struct("lo", "w", "k")).scalar())
    slot = F.least(F.floor((F.col("v") - F.col("_s.lo")) / F.col("_s.w")).cast("int"), F.col("_s.k") - 1)
    counted = binned.groupBy(slot.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    bins = stats.select("lo", "w", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    return (bins.join(F.broadcast(counted), "i", "left").select(
        "i", (F.col("lo") + F.col("i") * F.col("w")).alias("x0"), (F.col("lo") + (F.col("i") + 1) * F.col("w")).alias("x1"),
        F.coalesce("n", F.lit(0)).alias("count")).orderBy("i"))


def heat_grid(df: DataFrame, x: str, y: str, weight: str) -> DataFrame:
    """``(x, y, weight, share)`` cells; cells with a NULL part are dropped, share is of the largest weight."""
    cells = df.select(_time(df, x).alias("x"), _number(df, y).alias("y"), _number(df, weight).alias("weight")).dropna()
    top = cells.agg(F.greatest(F.max("weight"), F.lit(1.0))).scalar()
    return cells.withColumn("share", F.col("weight") / top)


def heat_columns(df: DataFrame) -> tuple[str, str, str] | None:
    """Time, y and weight column of a heat grid, by name and position."""
    n, numeric, present, _ = _facts(df)
    usable = [c for c in df.columns if numeric[c] > 0 or (
        present[c] > 0 and isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)))]
    x = next((c for c in usable if TIME_NAME.match(c)), None)
    rest = [c for c in usable if c != x and numeric[c] > 0]
    return (x, rest[0], rest[1]) if n >= 2 and x is not None and len(rest) >= 2 else None


def last_numeric(df: DataFrame, order: list[str], column: str | None = None) -> DataFrame:
    """The last number of a column (the first numeric one by default) in the given order."""
    if column is None:
        _, numeric, *_ = _facts(df)
        column = next(c for c in df.columns if numeric[c] > 0)
    v = _number(df, column)
    return df.agg(F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias("last_value"))


_EVENT = "array<struct<name:string,time_ns:string,attributes:string,dropped_attributes_count:bigint>>"
_LINK = ("array<struct<trace_id:string,span_id:string,trace_state:string,attributes:string,"
         "dropped_attributes_count:bigint,flags:bigint>>")


def span_events(spans: DataFrame) -> DataFrame:
    """One row per span event."""
    return spans.where(F.col("events").isNotNull()).select(
        "trace_id", "span_id", F.posexplode(F.from_json("events", _EVENT)).alias("i", "e")).select(
        "trace_id", "span_id", "i", "e.name", F.col("e.time_ns").try_cast("bigint").alias("time_ns"),
        "e.attributes", "e.dropped_attributes_count")


def span_links(spans: DataFrame) -> DataFrame:
    """One row per span link; the linked ids are ``to_trace_id`` and ``to_span_id``."""
    return spans.where(F.col("links").isNotNull()).select(
        "trace_id", "span_id", F.posexplode(F.from_json("links", _LINK)).alias("i", "l")).select(
        "trace_id", "span_id", "i", F.col("l.trace_id").alias("to_trace_id"), F.col("l.span_id").alias("to_span_id"),
        "l.trace_state", "l.attributes", "l.dropped_attributes_count", "l.flags")


def attribute_rows(df: DataFrame, ids: list[str], *json_columns: str) -> DataFrame:
    """One row per attribute of the given JSON columns."""
    parts = [df.where(F.col(c).isNotNull()).select(
        *ids, F.lit(c).alias("origin"), F.explode(key_values(F.col(c))).alias("key", "value")) for c in json_columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
