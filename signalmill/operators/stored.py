"""Lookups and totals on a store that read its file indexes first.

Each gives the rows of its namesake on whole tables. Which files are read is
settled when the frame is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import store
from .filters import filter_logs, filter_spans
from .traces import TraceDetail, trace_detail as detail_of

_COUNTS = {"spans": "spans", "log_records": "logs", "metric_points": "metric_points"}


def trace_detail(spark: SparkSession, root: str, trace_id: str) -> TraceDetail:
    return detail_of(store.read_matching(spark, root, "spans", {"trace_id": trace_id}), trace_id)


def logs_of_trace(spark: SparkSession, root: str, trace_id: str, span_id: str | None = None) -> DataFrame:
    ids = {"trace_id": trace_id} | ({"span_id": span_id} if span_id else {})
    return filter_logs(store.read_matching(spark, root, "log_records", ids), trace_id=trace_id, span_id=span_id)


def search_logs(spark: SparkSession, root: str, q: str, **filters) -> DataFrame:
    return filter_logs(store.read_matching(spark, root, "log_records", q=q), q=q, **filters)


def search_spans(spark: SparkSession, root: str, q: str, **filters) -> DataFrame:
    return filter_spans(store.read_matching(spark, root, "spans", q=q), q=q, **filters)


def approximate_stats(spark: SparkSession, root: str) -> DataFrame:
    """The columns of ``catalog.stats`` from the facts of the files alone; no signal table is read.

    Counts and times are exact. Distinct counts come from sketches of 2^12 registers, united over all files: their standard
    error is 1.6 percent. Batches without an index are not counted.
    """
    zero = F.lit(0).cast("bigint")
    parts = []
    for table, counted in _COUNTS.items():
        facts = store.file_facts(spark, root, table)
        sketch = lambda column: F.col("sketches")[column]
        parts.append(facts.select(
            *[(F.col("rows") if c == counted else zero).alias(c) for c in _COUNTS.values()], "first_ns", "last_ns",
            sketch("service_name").alias("_services"),
            (sketch("trace_id") if table == "spans" else F.lit(None).cast("binary")).alias("_traces"),
            (sketch("metric_name") if table == "metric_points" else F.lit(None).cast("binary")).alias("_metrics")))
    files = parts[0].unionByName(parts[1]).unionByName(parts[2])
    distinct = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), zero)
    return files.agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in _COUNTS.values()], distinct("_traces").alias("traces"),
        distinct("_metrics").alias("metrics"), distinct("_services").alias("services"),
        F.min("first_ns").alias("earliest_ns"), F.max("last_ns").alias("latest_ns"))


def daily_services(spark: SparkSession, root: str, table: str = "spans") -> DataFrame:
    """Rows and approximate number of services per day, from the facts of the files."""
    return store.file_facts(spark, root, table).groupBy("event_date").agg(
        F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg(F.col("sketches")["service_name"])).alias("services"))
