"""The console's example queries as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import round_to
from ..functions.timeutil import HALF_MINUTE, bucket_ts
from ..operators import counters, histograms, logs as log_ops
from ..operators.skew import exact_quantiles


def spans_by_service(spans: DataFrame) -> DataFrame:
    # Whole nanoseconds are summed, so the mean does not depend on the order of rows.
    ns = F.sum((F.col("duration_ms") * 1e6).cast("bigint"))
    return (spans.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("spans"), round_to(ns / F.count(F.lit(1)) / 1e6, 2).alias("avg_ms"))
        .orderBy(F.desc("spans"), "service_name"))


def p95_by_service(spans: DataFrame) -> DataFrame:
    found = exact_quantiles(spans, ["service_name"], "duration_ms", {"p95_ms": "0.95"}, interpolate=True)
    return found.withColumn("p95_ms", round_to(F.col("p95_ms"), 2)).orderBy(F.desc("p95_ms"), "service_name")


def error_traces(spans: DataFrame, limit: int = 100) -> DataFrame:
    return (spans.where(F.col("status_code") == 2).orderBy(F.desc("start_ns"), "span_id").limit(limit)
            .select("trace_id", "span_name", "status_message", "duration_ms"))


def slowest_spans(spans: DataFrame, limit: int = 50) -> DataFrame:
    return (spans.orderBy(F.desc("duration_ms"), "span_id").limit(limit)
            .select("span_name", "service_name", "duration_ms", "span_attributes"))


def logs_by_severity(logs: DataFrame) -> DataFrame:
    return logs.groupBy("severity_text").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "severity_text")


def recent_error_logs(logs: DataFrame, limit: int = 100) -> DataFrame:
    return (logs.where(F.col("severity_number") >= 17).orderBy(*log_ops.log_order()).limit(limit)
            .select(bucket_ts(F.col("time_ns"), 1000).alias("ts"), "service_name", "body"))


def gauge_values(points: DataFrame, limit: int = 500) -> DataFrame:
    return (points.where(F.col("metric_type") == "gauge")
            .orderBy(F.desc("ts_ns"), "metric_name", "service_name", "series_attributes", "resource_attributes").limit(limit)
            .select("metric_name", "service_name", (F.col("ts_ns") / 1e9).alias("ts"), "value_double"))


def histogram_means(points: DataFrame, limit: int = 200) -> DataFrame:
    return (points.where(F.col("hist_count") > 0)
            .orderBy(F.desc("ts_ns"), "metric_name", "service_name", F.asc_nulls_last("series_attributes"), "resource_attributes")
            .limit(limit)
            .select("metric_name", "service_name",
                    round_to(histograms.histogram_mean(F.col("hist_sum"), F.col("hist_count")), 3).alias("mean")))


def users_over_time(points: DataFrame, metric: str = "locust.current_users") -> DataFrame:
    return counters.gauge_series(points, metric, value="users")


def latency_p95(points: DataFrame, metric: str = "locust.client.duration", width_ns: int = HALF_MINUTE) -> DataFrame:
    """p95 per bucket without the finite-bound fallback: mass in the open bucket gives infinity."""
    return histograms.histogram_percentiles(points, metric, width_ns, (0.95,), ("p95_s",), finite_only=False)


def requests_per_second(points: DataFrame, metric: str = "locust.client.duration", width_ns: int = HALF_MINUTE) -> DataFrame:
    return counters.counter_rate(points, metric, width_ns)
