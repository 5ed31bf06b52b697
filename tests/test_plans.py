"""The physical plans: pruning, push-down, no cartesian products."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from signalmill.operators import catalog, filters, red, traces
from signalmill.sources import store, tables
from signalmill.sources.envelope import flatten_traces


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def root(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    for name, df in tables.signal_tables(spark, small).items():
        promote = (("span_attributes", "http.route"),) if name == "spans" else ()
        store.append(df, path, name, promote)
    return path


def test_day_partitions_are_pruned(spark, root):
    spans = store.read_table(spark, root, "spans")
    day = 1_704_067_200_000_000_000 + 3 * 86_400_000_000_000
    kept = filters.select_spans(spans, from_ns=day, to_ns=day + 86_399_999_999_999)
    text = plan(kept.select("trace_id"))
    assert "PartitionFilters" in text and "event_date" in text.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(start_ns" in text
    assert kept.select(F.countDistinct("event_date")).first()[0] == 1
    whole = spans.where((F.col("start_ns") >= day) & (F.col("start_ns") <= day + 86_399_999_999_999))
    assert kept.count() == whole.count() > 0


def test_columns_are_pruned_and_service_pushed(spark, root):
    spans = store.read_table(spark, root, "spans")
    text = plan(red.span_rate(spans, service="svc-1"))
    schema = text.split("ReadSchema:")[1].split(">")[0]
    assert "start_ns" in schema and "span_attributes" not in schema and "events" not in schema
    assert "EqualTo(service_name,svc-1)" in text


def test_promoted_attribute_is_a_pushed_filter(spark, root):
    spans = store.read_table(spark, root, "spans", (("span_attributes", "http.route"),))
    text = plan(red.span_rate(spans, attributes={"http.route": "/view"}))
    assert "/view" in text.split("PushedFilters")[1]
    plain = store.read_table(spark, root, "spans")
    count = lambda df: filters.select_spans(df, attributes={"http.route": "/view"}).count()
    assert count(spans) == count(plain) > 0


def test_balanced_store_writes_one_sorted_file_per_small_day(spark, root):
    files = store.read_table(spark, root, "spans").select("event_date", F.input_file_name().alias("f")).distinct()
    assert files.groupBy("event_date").count().agg(F.max("count")).first()[0] == 1


def test_metric_filter_leaves_one_branch_of_the_union(spark, small):
    text = plan(filters.filter_points(tables.metric_points(spark, small), "app.value").select("ts_ns"))
    assert "Union" not in text and text.count("FileScan") == 1


def test_trace_summary_aggregates_before_the_shuffle(spark, small):
    text = plan(traces.trace_summary(tables.spans(spark, small)))
    assert text.count("Exchange") == 1 and "partial_min" in text and "Window" not in text


def test_paging_is_a_bounded_top_k(spark, root):
    text = plan(traces.traces_list(store.read_table(spark, root, "spans"), limit=10))
    assert "TakeOrderedAndProject" in text


def test_table_stats_read_no_columns(spark, root):
    stored = {t: df.drop("event_date") for t, df in store.read_tables(spark, root).items()}
    assert "ReadSchema: struct<>" in plan(catalog.table_stats(stored))


def test_flattening_uses_python_for_nested_values_only(spark):
    lines = spark.createDataFrame([("{}",)], "value string")
    text = plan(flatten_traces(lines))
    assert text.count("ArrowEvalPython") == 2 and "BatchEvalPython" not in text


SLOW = {"c6_waterfall", "t1_stream_ingest", "t2_stream_red", "t3_stream_increase", "t4_stream_traces", "t5_stream_counts", "s4_append",
        "s5_reset", "s10_table_stats", "t1_stream_logs", "t1_stream_metrics", "t4_stream_sessions",
        "t5_stream_all_counts"}  # streams: what is left of them is a scan of their result


@pytest.mark.parametrize("key", sorted(set(queries()) - SLOW))
def test_no_cartesian_product(spark, small, key):
    text = plan(queries()[key](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
