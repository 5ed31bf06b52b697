"""Rate, errors and duration of spans per time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import round_to
from ..functions.timeutil import HALF_MINUTE, NS_PER_S, bucket_ts
from .filters import attribute_column, select_spans
from .skew import exact_quantiles


def bucketed(spans: DataFrame, width_ns: int) -> DataFrame:
    return spans.withColumn("ts", bucket_ts(F.col("start_ns"), width_ns))


def rate_column(width_ns: int):
    return round_to(F.count(F.lit(1)) / (width_ns / NS_PER_S), 2)


def error_share_column():
    """Percent of spans with an error status; the dashboards count status 2 and above."""
    return round_to(F.count_if(F.col("status_code") >= 2) * 100.0 / F.count(F.lit(1)), 2)


def span_rate(spans: DataFrame, width_ns: int = HALF_MINUTE, **where) -> DataFrame:
    kept = bucketed(select_spans(spans, **where), width_ns)
    return kept.groupBy("ts").agg(rate_column(width_ns).alias("rps")).orderBy("ts")


def span_error_share(spans: DataFrame, width_ns: int = HALF_MINUTE, **where) -> DataFrame:
    kept = bucketed(select_spans(spans, **where), width_ns)
    return kept.groupBy("ts").agg(error_share_column().alias("err_pct")).orderBy("ts")


def span_quantile(spans: DataFrame, width_ns: int = HALF_MINUTE, share: str = "0.95",
                  name: str = "p95_ms", **where) -> DataFrame:
    """Discrete duration quantile per bucket, exact for buckets of any size."""
    kept = bucketed(select_spans(spans, **where), width_ns)
    found = exact_quantiles(kept, ["ts"], "duration_ms", {name: share})
    return found.withColumn(name, round_to(F.col(name), 2)).orderBy("ts")


def top_routes(spans: DataFrame, attr: str = "http.route", **where) -> DataFrame:
    """Requests per route, or per span name where there is no route, largest first."""
    kept = select_spans(spans, **where)
    route = F.coalesce(attribute_column(kept, "span_attributes", attr), F.col("span_name"))
    return (kept.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("requests"))
            .orderBy(F.desc("requests"), "route"))
