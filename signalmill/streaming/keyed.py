"""Trace summaries by session, with state per trace.

A trace is closed when no span of it has come for a while, by Spark's session
windows: a trace across midnight is one row, and needs no merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.timeutil import ns_to_timestamp


def session_summaries(spans: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The columns of ``trace_summary`` for each stretch of a trace without a pause of ``gap``, in append mode.

    A row comes out once, when the watermark has passed the end of the session; spans later than that are dropped.
    """
    timed = spans.withColumn("_at", ns_to_timestamp(F.col("start_ns"))).withWatermark("_at", late)
    first = F.min_by(F.struct("span_name", "service_name"), F.struct("start_ns", "span_id"))
    return (timed.groupBy("trace_id", F.session_window("_at", gap).alias("_w")).agg(
        F.min("start_ns").alias("start_ns"), (F.max("end_ns") - F.min("start_ns")).alias("duration_ns"),
        F.count(F.lit(1)).alias("span_count"), F.count_if(F.col("status_code") == 2).alias("error_count"),
        first.alias("_first"), F.array_sort(F.collect_set("service_name")).alias("services"))
        .select("trace_id", "start_ns", "duration_ns", "span_count", "error_count",
                F.col("_first.span_name").alias("root_name"), F.col("_first.service_name").alias("service"), "services"))
