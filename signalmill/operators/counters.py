"""Reset-safe increases and rates of cumulative counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsontext import attribute
from ..functions.numbers import round_to
from ..functions.timeutil import HALF_MINUTE, NS_PER_S, bucket_start, bucket_ts
from ..schemas import DELTA
from .filters import filter_points
from .skew import chunk_of, with_previous

SERIES = ("series_attributes",)
CHUNK_NS = 600 * NS_PER_S


def observed(points: DataFrame, metric: str, **where) -> DataFrame:
    """Histogram points of a metric that counted something; empty points go before any difference."""
    return filter_points(points, metric, **where).where(F.col("hist_count") > 0)


def point_order(values: tuple[str, ...] = ()) -> list[str]:
    """Time order; the rest breaks ties of points that share series and time."""
    return ["ts_ns", "service_name", "resource_attributes", *values]


def _chunk(chunk_ns: int, edges: list[int] | None) -> Column:
    ts = F.col("ts_ns")
    return chunk_of(ts, edges) if edges else bucket_start(ts, chunk_ns)


def counter_increase(points: DataFrame, series_keys: tuple[str, ...] = SERIES,
                     values: tuple[str, ...] = ("hist_count",), chunk_ns: int = CHUNK_NS,
                     edges: list[int] | None = None) -> DataFrame:
    """Adds ``inc_<v>``, the rise of ``v`` since the point before it in its series.

    A fall (counter reset) and the first point of a series count 0. Points are
    compared within time chunks and across chunk borders, so a long or hot
    series spreads over tasks; ``edges`` from ``skew.balanced_edges`` replace the
    fixed chunks where points are bunched in time.
    """
    joined = with_previous(points, list(series_keys), point_order(values), list(values), _chunk(chunk_ns, edges))
    for v in values:
        rise = F.col(v) - F.col(f"prev_{v}")
        joined = joined.withColumn(f"inc_{v}", F.greatest(rise, F.lit(0).cast(points.schema[v].dataType)))
    return joined.drop(*[f"prev_{v}" for v in values])


def counter_rate(points: DataFrame, metric: str, width_ns: int = HALF_MINUTE,
                 series_keys: tuple[str, ...] = SERIES, edges: list[int] | None = None, **where) -> DataFrame:
    """Requests per second and bucket from a cumulative histogram count."""
    rises = counter_increase(observed(points, metric, **where), series_keys, edges=edges)
    return (rises.groupBy(bucket_ts(F.col("ts_ns"), width_ns).alias("ts"))
            .agg(round_to(F.sum("inc_hist_count") / (width_ns / NS_PER_S), 2).alias("rps"))
            .orderBy("ts"))


def increase_total(points: DataFrame, metric: str, series_keys: tuple[str, ...] = SERIES,
                 edges: list[int] | None = None, **where) -> DataFrame:
    """The increase over the whole range as one number."""
    rises = counter_increase(observed(points, metric, **where), series_keys, edges=edges)
    return rises.agg(F.sum("inc_hist_count").alias("requests"))


def increase_by(points: DataFrame, metric: str, attr: str, label: str, null_label: str | None = None,
                series_keys: tuple[str, ...] = SERIES, edges: list[int] | None = None, **where) -> DataFrame:
    """The increase per value of a series attribute, largest first.

    Series without the attribute are left out, or counted under ``null_label``.
    """
    rises = counter_increase(observed(points, metric, **where), series_keys, edges=edges)
    named = rises.withColumn(label, attribute(F.col("series_attributes"), attr))
    named = named.where(F.col(label).isNotNull()) if null_label is None else named.withColumn(
        label, F.coalesce(F.col(label), F.lit(null_label)))
    return (named.groupBy(label).agg(F.sum("inc_hist_count").alias("requests"))
            .orderBy(F.desc("requests"), label))


def endpoint_stats(points: DataFrame, metric: str, series_keys: tuple[str, ...] = SERIES,
                 edges: list[int] | None = None, **where) -> DataFrame:
    """Count, failures, mean, maximum and rate per endpoint, with a ``Total`` row at the end."""
    rises = counter_increase(observed(points, metric, **where), series_keys, ("hist_count", "hist_sum"), edges=edges)
    n, secs = F.col("inc_hist_count"), F.col("inc_hist_sum")
    failed = attribute(F.col("series_attributes"), "error.type").isNotNull()
    latest = F.max_by("hist_max", F.struct(*point_order(), "series_attributes", "hist_max"))
    per_name = (rises.groupBy(attribute(F.col("series_attributes"), "name").alias("name")).agg(
        F.sum(n).alias("n"), F.sum(F.when(failed, n).otherwise(0)).alias("failures"), F.sum(secs).alias("total_s"),
        latest.alias("mx"), F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi")))
    # The total is summed from the few rows per endpoint, not from the points again. All three
    # uses read the same columns, so they share the shuffle behind ``per_name``.
    parts = ("n", "failures", "total_s", "mx", "lo", "hi")
    total = per_name.agg(*[(F.min if c == "lo" else F.max if c in ("mx", "hi") else F.sum)(c).alias(c) for c in parts])
    rows = per_name.select("name", *parts, F.lit(False).alias("is_total")).unionByName(
        total.select(F.lit(None).cast("string").alias("name"), *parts, F.lit(True).alias("is_total")))
    whole = total.select(F.struct(*parts)).scalar()
    return (_endpoint_columns(rows.withColumn("_all", whole))
            .orderBy("is_total", F.asc_nulls_last("Name")).drop("is_total"))


def _endpoint_columns(rows: DataFrame) -> DataFrame:
    n = F.nullif(F.col("n"), F.lit(0).cast("bigint")).cast("double")
    share = round_to(F.col("failures").cast("double") * 100.0 / n, 1)
    own_max = F.when(F.col("name").isNotNull(), F.col("mx"))
    # The row's own bounds change nothing here; reading them keeps this plan's columns equal to
    # those behind ``_all``, so that Spark runs the shared part once.
    newest, oldest = F.greatest("_all.hi", "hi"), F.least("_all.lo", "lo")
    seconds = F.nullif((newest - oldest) / 1e9, F.lit(0.0))
    return rows.select(
        F.when(F.col("is_total"), "Total").otherwise(F.coalesce("name", F.lit("(no name)"))).alias("Name"),
        F.col("n").alias("Count"),
        F.concat(F.col("failures").cast("string"), F.lit(" ("), share.cast("string"), F.lit("%)")).alias("Failures"),
        round_to(F.col("total_s") / n * 1000.0, 1).alias("Avg (ms)"),
        round_to(F.coalesce(own_max, F.col("_all.mx"), F.lit(0.0)) * 1000.0, 1).alias("Max (ms)"),
        round_to(F.col("n").cast("double") / seconds, 2).alias("Rate/s"), "is_total")


def rate(points: DataFrame, metric: str, width_ns: int = HALF_MINUTE,
         series_keys: tuple[str, ...] = (*SERIES, "service_name", "resource_attributes"),
         edges: list[int] | None = None, **where) -> DataFrame:
    """Rate over all series of a metric, whatever its temporality.

    Delta points give their count over their own window; cumulative points are
    differenced first and spread over the time since the point before them.
    """
    kept = observed(points, metric, **where)
    is_delta = F.col("aggregation_temporality") == DELTA
    delta = kept.where(is_delta).select(
        "ts_ns", F.col("hist_count").alias("n"), (F.col("ts_ns") - F.col("start_ns")).alias("span_ns"))
    cumulative = kept.where(~F.coalesce(is_delta, F.lit(False)))
    before = with_previous(cumulative.withColumn("at_ns", F.col("ts_ns")), list(series_keys),
                           point_order(("hist_count",)), ["hist_count", "at_ns"], _chunk(CHUNK_NS, edges))
    differenced = before.where(F.col("prev_at_ns").isNotNull()).select(
        "ts_ns", F.greatest(F.col("hist_count") - F.col("prev_hist_count"), F.lit(0)).alias("n"),
        (F.col("ts_ns") - F.col("prev_at_ns")).alias("span_ns"))
    # Whole and decimal numbers add up to the same whatever the order; the one division of doubles comes last.
    per_second = (F.col("n").cast("decimal(19,0)") * F.lit(10 ** 9).cast("decimal(10,0)") / F.nullif(F.col("span_ns"), F.lit(0)).cast("decimal(19,0)")).cast("decimal(38,10)")
    return (delta.unionByName(differenced)
            .groupBy(bucket_ts(F.col("ts_ns"), width_ns).alias("ts"))
            .agg(round_to(F.sum(per_second).cast("double"), 4).alias("rps"), F.sum("n").alias("requests"))
            .orderBy("ts"))


def gauge_value() -> Column:
    return F.coalesce(F.col("value_double"), F.col("value_int").cast("double"))


def gauge_series(points: DataFrame, metric: str, latest: bool = False, value: str = "value", **where) -> DataFrame:
    """Gauge values over time, or only the latest one."""
    kept = filter_points(points, metric, **where)
    if latest:
        return (kept.orderBy(F.desc("ts_ns"), "service_name", "series_attributes", "resource_attributes").limit(1)
                .select(gauge_value().alias(value)))
    return (kept.orderBy("ts_ns", "service_name", "series_attributes")
            .select(bucket_ts(F.col("ts_ns"), 1000).alias("ts"), gauge_value().alias(value)))
