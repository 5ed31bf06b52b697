"""Metric catalogue, metric detail and its chart shapes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsontext import double_array, key_values
from ..functions.timeutil import is_finite
from .counters import gauge_value
from .filters import filter_metrics, filter_points, page_size

POINT_COLUMNS = (
    "service_name", "scope_name", "series_attributes", "resource_attributes", "exemplars", "metric_metadata",
    "aggregation_temporality", "is_monotonic", "start_ns", "ts_ns", "value_double", "value_int", "hist_count",
    "hist_sum", "hist_min", "hist_max", "hist_bounds", "hist_bucket_counts", "exp_zero_count", "exp_scale",
    "exp_zero_threshold", "exp_buckets", "summary_count", "summary_sum", "summary_quantiles")

_TIES = ("service_name", "series_attributes", "resource_attributes")
_BUCKETS = "struct<positive:struct<offset:int,bucket_counts:array<bigint>>,negative:struct<offset:int,bucket_counts:array<bigint>>>"


class MetricDetail(NamedTuple):
    metadata: DataFrame
    points: DataFrame
    truncated: DataFrame


def metric_summary(points: DataFrame, any_value: bool = False) -> DataFrame:
    """One row per metric: points, services, first and last time and last value.

    The last value looks at double values only; ``any_value`` takes integer
    values as well.
    """
    value = gauge_value() if any_value else F.col("value_double")
    newest = F.max_by(value, F.when(value.isNotNull(), F.struct("ts_ns", *_TIES, value.alias("v"))))
    return points.groupBy("metric_name", "metric_type", "metric_unit", "metric_description").agg(
        F.count(F.lit(1)).alias("point_count"),
        F.array_sort(F.collect_set("service_name")).alias("services"),
        F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), newest.alias("last_value"),
    ).withColumn("service_count", F.size("services").cast("bigint"))


def metrics_list(points: DataFrame, service: str | None = None, q: str | None = None,
                 limit: int | None = None, any_value: bool = False) -> DataFrame:
    return (metric_summary(filter_metrics(points, service, q), any_value)
            .orderBy("metric_name", "metric_type", F.asc_nulls_last("metric_unit"), F.asc_nulls_last("metric_description"))
            .limit(page_size(limit, 100)))


def metric_detail(points: DataFrame, name: str, service: str | None = None, start_ns: int | None = None,
                  end_ns: int | None = None, limit: int | None = None, newest: bool = False) -> MetricDetail:
    """Metadata and points of a metric, oldest first; both are empty when it is unknown.

    A full page holds the oldest points; ``newest`` takes the newest instead.
    """
    own = filter_points(points, name, service, start_ns, end_ns)
    about = own.select("metric_name", "metric_type", "metric_unit", "metric_description").limit(1)
    size = page_size(limit, 5000)
    found = own
    oldest_first = ["ts_ns", *[F.asc_nulls_first(c) for c in _TIES]]
    if newest:
        own = own.orderBy(F.desc("ts_ns"), *[F.desc_nulls_last(c) for c in _TIES]).limit(size)
    page = own.orderBy(*oldest_first).limit(size)
    truncated = found.limit(size + 1).agg((F.count(F.lit(1)) > size).alias("truncated"))
    return MetricDetail(about, page.select(*POINT_COLUMNS), truncated)


def point_value(points: DataFrame) -> Column:
    """The one number a chart shows for a point of any metric type.

    Gauges and sums show their value, histograms and summaries their mean,
    exponential histograms the number of observations. NULL where that is none.
    """
    buckets = F.from_json("exp_buckets", _BUCKETS)
    add = lambda side: F.coalesce(F.aggregate(
        buckets[side]["bucket_counts"], F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0))
    seen = F.coalesce("exp_zero_count", F.lit(0)) + add("positive") + add("negative")
    mean = lambda total, n: F.when(F.col(n) > 0, F.coalesce(total, F.lit(0.0)) / F.col(n))
    kind = F.col("metric_type")
    return (F.when(kind == "histogram", mean("hist_sum", "hist_count"))
            .when(kind == "exponential_histogram", F.when(seen > 0, seen.cast("double")))
            .when(kind == "summary", mean("summary_sum", "summary_count"))
            .otherwise(gauge_value()))


def series_key() -> Column:
    """``service|k=v,...`` of a point."""
    pairs = F.transform(F.map_entries(key_values(F.col("series_attributes"))),
                        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return F.concat("service_name", F.lit("|"), F.coalesce(F.array_join(pairs, ","), F.lit("")))


def series_points(points: DataFrame, metric: str, **where) -> DataFrame:
    """``(t_ms, series, v)`` of a metric."""
    kept = filter_points(points, metric, **where)
    return kept.select((F.col("ts_ns") / 1e6).alias("t_ms"), series_key().alias("series"),
                       point_value(kept).alias("v"), "ts_ns", "resource_attributes")


def series_wide(points: DataFrame, metric: str, keys: list[str], rest: str | None = None, **where) -> DataFrame:
    """One column per series over sorted times; the caller names the series, so the width is known.

    With ``rest`` a column of that name counts the points of each time whose series is not among ``keys``; without it their
    times are rows all the same, their values are in no column.
    """
    found = series_points(points, metric, **where)
    first = F.min_by("v", F.struct("resource_attributes", "v"))
    wide = found.groupBy("t_ms").pivot("series", keys).agg(first)
    if rest is not None:
        if rest in keys:
            raise ValueError(f"{rest} is the name of a series")
        others = found.groupBy("t_ms").agg(F.count_if(~F.coalesce(F.col("series").isin(keys), F.lit(False))).alias(rest))
        wide = wide.join(others, "t_ms")  # both are grouped by time: one shuffle each, none for the join
    return wide.orderBy("t_ms")


def last_point(points: DataFrame, metric: str, **where) -> DataFrame:
    kept = filter_points(points, metric, **where)
    return kept.orderBy(F.desc("ts_ns"), *[F.desc_nulls_last(c) for c in _TIES]).limit(1)


def histogram_buckets(points: DataFrame, metric: str, **where) -> DataFrame:
    """Labelled bucket counts of the last histogram point."""
    bounds = double_array(F.col("hist_bounds"))
    rows = last_point(points, metric, **where).select(
        bounds.alias("b"), F.posexplode(double_array(F.col("hist_bucket_counts"))).alias("i", "count"))
    size = F.coalesce(F.size("b"), F.lit(0))
    at = lambda i: _number_text(F.try_element_at("b", i))
    label = F.when(F.col("i") < size, F.concat(F.lit("≤"), at(F.col("i") + 1))).otherwise(
        F.concat(F.lit(">"), F.coalesce(at(F.when(size > 0, size).otherwise(1)), F.lit("∞"))))
    return rows.select("i", label.alias("bucket"), "count").orderBy("i")


def _number_text(x: Column) -> Column:
    """A double without a needless ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def exponential_buckets(points: DataFrame, metric: str, **where) -> DataFrame:
    """Bucket counts of the last exponential histogram point.

    ``bucket`` labels follow the reference: ``zero``, then a power of two per
    positive bucket whatever the scale. ``side`` and ``upper_bound`` give the true
    bounds, negative buckets included.
    """
    last = last_point(points, metric, **where).select(
        F.coalesce("exp_zero_count", F.lit(0)).alias("zero"), "exp_scale", "exp_zero_threshold",
        F.from_json("exp_buckets", _BUCKETS).alias("b"))
    base = F.pow(F.lit(2.0), F.pow(F.lit(2.0), -F.col("exp_scale")))
    halves = []
    for side, sign in (("positive", 1.0), ("negative", -1.0)):
        offset = F.coalesce(F.col(f"b.{side}.offset"), F.lit(0))
        rows = last.select("exp_scale", offset.alias("offset"),
                           F.posexplode(F.col(f"b.{side}.bucket_counts")).alias("i", "count"))
        label = F.concat(F.lit("2^"), (F.col("offset") + F.col("i") - 1).cast("string"))
        halves.append(rows.select(
            F.lit(side).alias("side"), (F.col("i") + 1).alias("i"),
            (label if side == "positive" else F.lit(None).cast("string")).alias("bucket"), "count",
            (F.pow(base, F.col("offset") + F.col("i") + 1) * sign).alias("upper_bound")))
    shown = (F.col("zero") != 0) | (F.size(F.col("b.positive.bucket_counts")) > 0)
    zero = last.where(shown).select(F.lit("zero").alias("side"), F.lit(0).alias("i"), F.lit("zero").alias("bucket"),
                       F.col("zero").alias("count"), F.col("exp_zero_threshold").alias("upper_bound"))
    return zero.unionByName(halves[0]).unionByName(halves[1])


def summary_quantiles(points: DataFrame, metric: str, **where) -> DataFrame:
    """``(q, v)`` of the last summary point, finite pairs only, in quantile order."""
    text = F.explode(F.from_json("summary_quantiles", "array<string>")).alias("e")
    entries = last_point(points, metric, **where).select(text)
    pair = F.from_json("e", "array<string>")
    named = F.from_json("e", "struct<quantile:string,value:string>")
    is_pair = F.col("e").startswith("[")
    q = F.when(is_pair, F.try_element_at(pair, F.lit(1))).otherwise(named["quantile"]).try_cast("double")
    v = F.when(is_pair, F.try_element_at(pair, F.lit(2))).otherwise(named["value"]).try_cast("double")
    return (entries.select(q.alias("q"), v.alias("v")).where(is_finite(F.col("q")) & is_finite(F.col("v")))
            .orderBy("q", "v"))
