"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores.
Every query is planned and run to the end (result dropped by the noop sink);
the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from signalmill.plans.registry import QUERIES
from signalmill.session import build_session

HEADLINE = (
    "s1_flatten_traces", "s2_flatten_logs", "s3_flatten_metrics", "a1_trace_summary", "a4_metric_summary",
    "a5_service_rollup", "a6_global_stats", "a13_quantile_cont", "w1_counter_increase", "j4_logs_to_spans",
    "j5_parent_child", "q1_traces_list", "q2_trace_detail", "q3_logs_list", "q5_metric_detail",
    "h1_histogram_percentiles", "h2_latency_heatmap", "h3_counter_rate", "h6_endpoint_stats", "h7_rate_cumulative",
    "h9_span_rate", "h10_span_error_share", "h11_span_p95", "h12_top_routes", "c2_series_wide", "c6_waterfall",
    "c10_value_histogram", "t1_stream_ingest", "t2_stream_red",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for key in HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[key] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
