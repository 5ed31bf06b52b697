"""Every operator as a named query over the tables of a data folder.

``QUERIES`` maps a key to ``f(spark, sf_dir) -> DataFrame``. Timestamps leave as
epoch microseconds and lists as joined text, so that results compare across
engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions import labels, variants
from ..functions.jsontext import attribute
from ..functions.numbers import round_to
from ..functions.timeutil import HALF_MINUTE, HOUR, bucket_start, epoch_ms, int_div
from ..operators import catalog, counters, filters, histograms, logs as log_ops, metrics, red, shaping, stored, traces
from ..operators.skew import exact_quantiles, with_previous
from ..session import scratch_path, widen
from ..sources import feed, store, tables
from ..sources.envelope import FLATTEN
from ..streaming import ingest, keyed, live
from . import console, examples, panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DURATION, DELTA, GAUGE, EXPONENTIAL, SUMMARY = (
    "app.duration", "app.duration.delta", "app.value", "app.latency.exp", "app.quantiles")


def comparable(df: DataFrame) -> DataFrame:
    """Timestamps as epoch microseconds, arrays of text as comma lists."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(key: str) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[key] = lambda spark, sf_dir: comparable(build(spark, sf_dir))
        return build
    return add


def on_spans(key: str, build: Callable[[DataFrame], DataFrame], parents: bool = False) -> None:
    query(key)(lambda spark, sf: build(tables.spans(spark, sf, parents)))


def on_logs(key: str, build: Callable[[DataFrame], DataFrame]) -> None:
    query(key)(lambda spark, sf: build(tables.log_records(spark, sf)))


def on_points(key: str, build: Callable[[DataFrame], DataFrame]) -> None:
    query(key)(lambda spark, sf: build(tables.metric_points(spark, sf)))


def on_all(key: str, build: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
    query(key)(lambda spark, sf: build(tables.signal_tables(spark, sf)))


# ------------------------------------------------------------ sources and sinks

def _flattened(spark, sf, table):
    return FLATTEN[table](feed.REQUESTS[table](widen(tables.events(spark, sf))))


query("s1_flatten_traces")(lambda spark, sf: _flattened(spark, sf, "spans"))
query("s2_flatten_logs")(lambda spark, sf: _flattened(spark, sf, "log_records"))
query("s3_flatten_metrics")(lambda spark, sf: _flattened(spark, sf, "metric_points").groupBy(
    "metric_name", "metric_type", "service_name").agg(F.count(F.lit(1)).alias("points"), F.max("ts_ns").alias("last_ns")))

_POINT_ID = ("metric_name", "service_name", "series_attributes", "ts_ns")
for _key, _kinds, _columns in (
        ("s3a_number_points", ("gauge", "sum"), ("aggregation_temporality", "is_monotonic", "start_ns", "value_double", "value_int")),
        ("s3b_histogram_points", ("histogram",), ("hist_count", "hist_sum", "hist_min", "hist_max", "hist_bounds",
                                                  "hist_bucket_counts", "exemplars")),
        ("s3c_exponential_points", ("exponential_histogram",), ("aggregation_temporality", "hist_count", "exp_zero_count",
                                                                "exp_scale", "exp_zero_threshold", "exp_buckets")),
        ("s3d_summary_points", ("summary",), ("summary_count", "summary_sum", "summary_quantiles", "exemplars", "flags"))):
    query(_key)(lambda spark, sf, kinds=_kinds, columns=_columns: _flattened(spark, sf, "metric_points").where(
        F.col("metric_type").isin(*kinds)).select(*_POINT_ID, *columns))


def _stored(spark, sf, names=("spans", "log_records", "metric_points")):
    """The signal tables after a round trip through the store."""
    root = scratch_path(spark, "store")
    for name in names:
        store.append(tables.signal_tables(spark, sf)[name], root, name)
    return root


@query("s4_append")
def _append(spark, sf):
    root = _stored(spark, sf, ("spans",))
    return (store.read_table(spark, root, "spans").groupBy(F.col("event_date").cast("string").alias("event_date"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ns").cast("decimal(20,0)")).cast("string").alias("end_sum")))


def _store_all(spark, sf):
    """All three tables as one batch of a store."""
    root = scratch_path(spark, "store")
    store.append_all(dict(tables.signal_tables(spark, sf)), root)
    return root


for _key, _table in (("s4_append_spans", "spans"), ("s4_append_logs", "log_records"), ("s4_append_points", "metric_points")):
    query(_key)(lambda spark, sf, t=_table: store.read_table(spark, _store_all(spark, sf), t).drop("event_date"))


@query("s4_compacted")
def _compacted(spark, sf):
    """Spans appended in three batches, one of them twice, and folded into one."""
    root, spans = scratch_path(spark, "store"), tables.spans(spark, sf)
    for k in (0, 1, 2, 1):
        store.append(spans.where(F.col("start_ns") % 3 == k), root, "spans", batch=f"part-{k}")
    store.compact(spark, root, "spans")
    store.append(spans.where(F.col("start_ns") % 3 == 2), root, "spans", batch="part-2")  # folded already: adds nothing
    return store.read_table(spark, root, "spans").drop("event_date")


@query("s5_reset")
def _reset(spark, sf):
    root = _stored(spark, sf)
    count = lambda when: [store.read_table(spark, root, t).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(t).alias("table_name"), F.lit(when).alias("state"), "n") for t in ("spans", "log_records", "metric_points")]
    before = spark.createDataFrame([r for part in count("before") for r in part.collect()], "table_name string, state string, n bigint")
    store.reset(spark, root)
    out = before
    for part in count("after"):
        out = out.unionByName(part)
    return out


on_spans("s6_scan_spans", lambda df: df.select(
    "trace_id", "span_id", "parent_span_id", "span_name", "span_kind", "start_ns", "end_ns", "duration_ms", "service_name",
    "resource_attributes", "span_attributes", "status_code", "status_message", "events", "links", "flags"), parents=True)
on_logs("s6_scan_logs", lambda df: df)
on_points("s6_scan_points", lambda df: df)


@query("s8_generate_series")
def _hours(spark, sf):
    """Span count of every hour between the first and the last span, empty hours included."""
    spans = tables.spans(spark, sf).select(bucket_start(F.col("start_ns"), HOUR).alias("hour"))
    axis = spans.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.lit(HOUR).cast("bigint"))).alias("hour"))
    return axis.join(spans.groupBy("hour").agg(F.count(F.lit(1)).alias("n")), "hour", "left").select(
        "hour", F.coalesce("n", F.lit(0)).alias("n"))


on_all("s9_schema_listing", catalog.schema_listing)


@query("s10_table_stats")
def _table_stats(spark, sf):
    root = _stored(spark, sf)
    stored = {t: df.drop("event_date") for t, df in store.read_tables(spark, root).items()}
    return catalog.table_stats(stored).select("table_name", "estimated_size", "column_count", (F.col("size_bytes") > 0).alias("has_bytes"))


# ------------------------------------------------------------ scalar functions

@query("f23_epoch_ms")
def _epoch(spark, sf):
    ns = tables.spans(spark, sf).select("span_id", "start_ns")
    texts = ns.select("span_id", F.col("start_ns").alias("ns"), int_div(F.col("start_ns"), 1000).alias("us"),
                      int_div(F.col("start_ns"), 1_000_000).alias("ms"), int_div(F.col("start_ns"), 1_000_000_000).alias("s"),
                      F.pmod("start_ns", F.lit(1000)).alias("small"))
    utc = F.to_utc_timestamp(F.timestamp_micros("us"), F.current_timezone())
    iso = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return texts.select("span_id", *[epoch_ms(F.col(c), T.LongType()).alias(f"{c}_ms") for c in ("ns", "us", "ms", "s", "small")],
                        epoch_ms(iso, T.StringType()).alias("iso_ms"))


@query("f25_enum_labels")
def _labels(spark, sf):
    spans = tables.spans(spark, sf).groupBy("span_kind", "status_code").agg(F.count(F.lit(1)).alias("n")).select(
        labels.span_kind_name(F.col("span_kind")).alias("kind"), labels.status_label(F.col("status_code")).alias("label"),
        labels.status_is_error(F.col("status_code")).alias("is_error"), "n")
    logs = tables.log_records(spark, sf).groupBy("severity_text").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("severity").alias("kind"), labels.severity_class(F.col("severity_text")).alias("label"),
        F.lit(False).alias("is_error"), "n")
    return spans.unionByName(logs)


# ------------------------------------------------------------ filters

MIDDLE = 1_704_067_200_000_000_000 + 5 * 24 * HOUR, 1_704_067_200_000_000_000 + 20 * 24 * HOUR

on_spans("p1_trace_filters", lambda df: traces.trace_summary(filters.filter_spans(
    df, service="svc-1", q="R", start_ns=MIDDLE[0], end_ns=MIDDLE[1], min_duration_ms=20.5)))
on_logs("p2_log_filters", lambda df: filters.filter_logs(
    df, service="svc-2", q="USER 1", severity="warn", start_ns=MIDDLE[0], end_ns=MIDDLE[1]).select("time_ns", "body", "severity_text"))
on_points("p3_metric_filters", lambda df: filters.filter_metrics(df, "svc-3", "DURATION").groupBy("metric_name").agg(
    F.count(F.lit(1)).alias("n")))
on_points("p4_point_filters", lambda df: filters.filter_points(df, GAUGE, "svc-3", *MIDDLE).select("ts_ns", "value_double", "value_int"))
on_points("p5_optional_parameters", lambda df: filters.filter_points(
    df, DURATION, None, series={"name": "error", "error.type": ""}, resource={"service.instance.id": "i-1"}).select(
    "ts_ns", "service_name", "hist_count"))
on_spans("p6_inclusive_range", lambda df: filters.between_ns(df, "start_ns", *MIDDLE).agg(
    F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("lo"), F.max("start_ns").alias("hi")))
query("p7_error_tests")(lambda spark, sf: tables.spans(spark, sf).groupBy("service_name").agg(
    F.count_if(F.col("status_code") == 2).alias("error_spans"), F.count_if(F.col("status_code") >= 2).alias("error_or_above"))
    .join(tables.log_records(spark, sf).groupBy("service_name").agg(
        F.count_if(F.col("severity_number") >= 17).alias("error_logs")), "service_name"))
on_points("p8_guards", lambda df: df.where((F.col("hist_count") > 0) & F.col("series_attributes").isNotNull()).groupBy("metric_name").agg(
    F.count(F.lit(1)).alias("n")))
on_spans("p9_time_presets", lambda df: filters.preset_range(df, "start_ns", "7d").select("span_id", "start_ns"))

# ------------------------------------------------------------ aggregations

on_spans("a1_trace_summary", traces.trace_summary)
on_spans("a2_error_traces", lambda df: traces.matching_traces(df, errors_only=True))
on_spans("a3_trace_total", lambda df: traces.trace_total(traces.matching_traces(df, errors_only=True)))
on_points("a4_metric_summary", metrics.metric_summary)
on_all("a5_service_rollup", catalog.service_rollup)
on_all("a6_global_stats", catalog.stats)
on_logs("a7_filtered_aggregate", lambda df: df.groupBy("service_name").agg(
    F.count_if(F.col("severity_number") >= 17).alias("errors"), F.max(F.when(F.col("trace_id").isNotNull(), F.col("time_ns"))).alias("last_traced_ns")))
on_spans("a8_arg_min_max", lambda df: df.groupBy("service_name").agg(
    F.min_by("span_name", F.struct("start_ns", "span_id")).alias("first_name"), F.max_by("span_name", F.struct("start_ns", "span_id")).alias("last_name")))
on_spans("a9_distinct_list", lambda df: df.groupBy("trace_id").agg(F.array_sort(F.collect_set("service_name")).alias("services")))
on_spans("a10_count_distinct", lambda df: df.groupBy("span_name").agg(F.count_distinct("trace_id").alias("traces")))


def _digits(c: Column) -> Column:
    """Six digits of a figure, whatever its size."""
    return F.when(c != 0, F.round(c / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c)))), 6)).otherwise(c)


@query("a18_summarize")
def _summarize(spark, sf):
    """The whole profile of the spans; distinct counts as whether they are within fifteen percent (three standard errors)."""
    spans = tables.spans(spark, sf)
    exact = spans.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in spans.columns]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("_exact")) for c in spans.columns])))
    found = catalog.summarize(spans).join(exact, "column_name")
    near = (F.abs(F.col("approx_unique") - F.col("_exact")) <= 0.15 * F.col("_exact")).alias("unique_near")
    quartiles = [_digits(F.col(q).cast("double")).alias(q) for q in ("q25", "q50", "q75")]
    return found.select("column_name", near, _digits(F.col("avg")).alias("avg"), _digits(F.col("std")).alias("std"), *quartiles, "count",
                        F.round("null_percentage", 6).alias("null_percentage"))


@query("f11_json_values")
def _json_values(spark, sf):
    """Body, attributes and broken text of the logs as values: their kind and what stands in them."""
    logs = tables.log_records(spark, sf).select("time_ns", "span_id", "body", "log_attributes", F.col("log_attributes").substr(1, 5).alias("broken"),
                                                F.concat(F.lit('{"a.b":{"c":[1,'), F.col("log_attributes"), F.lit("]}}")).alias("nested"))
    values = logs.select("time_ns", "span_id", *[variants.parse_or_keep(F.col(c)).alias(c) for c in ("body", "log_attributes", "broken", "nested")])
    return values.select(
        "time_ns", "span_id", *[variants.kind(F.col(c)).alias(f"{c}_kind") for c in ("body", "log_attributes", "broken", "nested")],
        variants.text_at(F.col("body")).alias("body_text"), variants.text_at(F.col("log_attributes"), "k").alias("k"),
        variants.text_at(F.col("broken")).alias("broken_text"), variants.text_at(F.col("nested"), "a.b", "c", 1, "k").alias("inner_k"))


def _by_name_and_total(points: DataFrame) -> DataFrame:
    rises = counters.counter_increase(counters.observed(points, DURATION))
    per = rises.groupBy(attribute(F.col("series_attributes"), "name").alias("name")).agg(F.sum("inc_hist_count").alias("n"))
    return per.rollup("name").agg(F.sum("n").alias("n"), F.grouping("name").alias("g")).select(
        F.when(F.col("g") == 1, "Total").otherwise(F.col("name")).alias("name"), "n")


on_points("a11_grouping_sets", _by_name_and_total)
on_spans("a12_quantile_disc", lambda df: exact_quantiles(red.bucketed(df, HOUR), ["ts"], "duration_ms", {"p50": "0.5", "p95": "0.95", "p99": "0.99"}))
on_spans("a13_quantile_cont", lambda df: exact_quantiles(
    df, ["span_name"], "duration_ms", {"p50": "0.5", "p95": "0.95"}, interpolate=True).select(
    "span_name", round_to(F.col("p50"), 4).alias("p50"), round_to(F.col("p95"), 4).alias("p95")))
on_spans("a14_conditional_share", lambda df: df.groupBy("service_name").agg(red.error_share_column().alias("err_pct")))
on_spans("a15_basic_aggregates", lambda df: df.groupBy("service_name", "span_kind").agg(
    F.count(F.lit(1)).alias("n"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
    F.sum(F.col("end_ns") - F.col("start_ns")).alias("sum_ns"),
    F.floor(F.sum(F.col("end_ns") - F.col("start_ns")) / F.count(F.lit(1))).cast("bigint").alias("avg_ns")))
on_points("a16_histogram_mean", lambda df: df.where(F.col("metric_name") == DURATION).select(
    "service_name", "series_attributes", "ts_ns", round_to(histograms.histogram_mean(F.col("hist_sum"), F.col("hist_count")), 3).alias("mean")))
on_all("a17_distinct_attribute", lambda t: catalog.attribute_options(t, "spans", "http.route"))
on_spans("a18_profile", lambda df: catalog.profile(df).select(
    "column_name", "min", "max", "count", "null_count").where(~F.col("column_name").isin("duration_ms")))

# ------------------------------------------------------------ windows

on_points("w1_counter_increase", lambda df: counters.counter_increase(counters.observed(df, DURATION)).select(
    "service_name", "series_attributes", "ts_ns", "hist_count", "inc_hist_count"))
on_points("w2_latest_per_group", lambda df: counters.observed(df, DURATION).groupBy("series_attributes").agg(
    F.max_by(F.struct("service_name", "ts_ns", "hist_count"), F.struct(*counters.point_order())).alias("p")).select("series_attributes", "p.*"))


def _running_counts(points: DataFrame) -> DataFrame:
    snaps = histograms._snapshots(points, DURATION, HOUR, {})
    cells = histograms.bucket_cells(F.array_append(histograms.finite_bounds(F.col("bounds")), F.lit(float("inf"))), F.col("counts"))
    run = snaps.select("ts", F.explode(histograms._running(cells)).alias("r"))
    return run.select("ts", F.coalesce(F.nullif("r.bound", F.lit(float("inf"))), F.lit(-1.0)).alias("bound"), F.col("r.cum").alias("cum_n"))


on_points("w3_running_sum", _running_counts)

# ------------------------------------------------------------ joins and sets


def _with_total(points: DataFrame) -> DataFrame:
    """Share of each bucket in its snapshot's total: buckets joined to totals."""
    snaps = histograms._snapshots(points, DURATION, HOUR, {})
    cells = snaps.select("ts", F.posexplode("counts").alias("i", "c"))
    totals = cells.groupBy("ts").agg(F.sum("c").alias("n"))
    return cells.join(totals, "ts").select("ts", "i", "c", "n")


on_points("j1_inner_join", _with_total)


def _name_left_last(points: DataFrame) -> DataFrame:
    """Counts per name with the last maximum of the name; a NULL name meets no partner."""
    pts = counters.observed(points, DURATION)
    name = F.when(F.col("service_name") != "svc-4", attribute(F.col("series_attributes"), "name"))
    rows = pts.withColumn("name", name)
    per = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    last = rows.groupBy("name").agg(F.max_by("hist_max", F.struct(*counters.point_order(("series_attributes", "hist_max")))).alias("mx"))
    return per.join(last, "name", "left")


on_points("j2_left_join", _name_left_last)
on_points("j3_scalar_subquery", lambda df: df.where(F.col("metric_name") == DURATION).groupBy("service_name").agg(
    F.max("hist_max").alias("mx")).withColumn("all_mx", df.where(F.col("metric_name") == DURATION).agg(F.max("hist_max")).scalar()))
query("j4_logs_to_spans")(lambda spark, sf: traces.logs_with_spans(tables.log_records(spark, sf), tables.spans(spark, sf)).select(
    "time_ns", "body", "trace_id", "span_id", "span_name", "span_service", "status_code"))
on_spans("j5_parent_child", lambda df: traces.with_parents(df).select(
    "trace_id", "span_id", "parent_span_id", "parent_name", "parent_service", "is_root"), parents=True)
on_all("u1_union_all", lambda t: t["spans"].select(F.lit("span").alias("signal"), "service_name", F.col("start_ns").alias("t"))
       .unionByName(t["log_records"].select(F.lit("log").alias("signal"), "service_name", F.col("time_ns").alias("t"))))
on_all("u2_service_set", catalog.services)

# ------------------------------------------------------------ sorts, limits, generators

on_spans("o1_newest_traces", lambda df: traces.trace_summary(df).orderBy(F.desc("start_ns"), "trace_id"))
on_logs("o2_newest_logs", lambda df: df.orderBy(*log_ops.log_order()).select("time_ns", "service_name", "body"))
on_points("o3_null_aware_sort", lambda df: df.groupBy("metric_unit").agg(F.count(F.lit(1)).alias("n")).orderBy(
    F.col("metric_unit").isNull(), "metric_unit"))
on_spans("o4_paging", lambda df: traces.traces_list(df, limit=50, offset=25))
on_spans("o5_top_k", lambda df: df.orderBy(F.desc("start_ns"), "span_id").limit(10).select("span_id", "start_ns", "service_name"))
on_points("g1_parallel_unnest", lambda df: df.where(F.col("metric_name") == DURATION).select(
    "service_name", "series_attributes", "ts_ns", F.inline(histograms.bucket_cells(
        histograms.double_array(F.col("hist_bounds")), histograms.double_array(F.col("hist_bucket_counts")))).alias("bound", "c")))


@query("g2_cte_chain")
def _cte(spark, sf):
    console.register_views(tables.signal_tables(spark, sf))
    return console.console_frame(spark, """
        WITH slow AS (SELECT trace_id, service_name, duration_ms FROM spans WHERE duration_ms > 50),
             per_trace AS (SELECT trace_id, count(*) AS n, max(duration_ms) AS longest FROM slow GROUP BY trace_id)
        SELECT n, count(*) AS traces, max(longest) AS longest FROM per_trace GROUP BY n""")


# ------------------------------------------------------------ composite queries

on_spans("q1_traces_list", lambda df: traces.traces_list(df, limit=200, q="err", errors_only=True))
on_spans("q1b_whole_traces", lambda df: traces.matching_traces(df, whole_trace=True, errors_only=True, service="svc-1", q="error"))


def _newest_trace(spans: DataFrame):
    return spans.agg(F.max_by("trace_id", F.struct("start_ns", "trace_id"))).scalar()


on_spans("q2_trace_detail", lambda df: traces.trace_detail(df, _newest_trace(df)).spans.select(
    "trace_id", "span_id", "parent_span_id", "span_name", "start_ns", "end_ns", "span_attributes", "events"), parents=True)
on_spans("q2_trace_detail_summary", lambda df: traces.trace_detail(df, _newest_trace(df)).summary)


@query("q2_trace_detail_stored")
def _detail_stored(spark, sf):
    """The newest trace, from the files that the store's index names."""
    root = _stored(spark, sf, ("spans",))
    newest = store.read_table(spark, root, "spans").agg(F.max_by("trace_id", F.struct("start_ns", "trace_id"))).first()[0]
    return stored.trace_detail(spark, root, newest).spans.select("trace_id", "span_id", "span_name", "start_ns", "end_ns", "span_attributes", "events")


@query("j4_logs_of_trace_stored")
def _logs_stored(spark, sf):
    root = _stored(spark, sf, ("log_records",))
    newest = store.read_table(spark, root, "log_records").where("trace_id is not null").agg(F.max_by("trace_id", F.struct("time_ns", "trace_id"))).first()[0]
    return stored.logs_of_trace(spark, root, newest).select("time_ns", "trace_id", "span_id", "body", "severity_text")


@query("p2_search_stored")
def _search_stored(spark, sf):
    return stored.search_logs(spark, _stored(spark, sf, ("log_records",)), "SE by user 1", severity="warn").select("time_ns", "span_id", "body")


@query("q7_stats_stored")
def _stats_stored(spark, sf):
    """Totals from the facts of the files; distinct counts as whether they are within five percent (three standard errors)."""
    root = _store_all(spark, sf)
    exact = catalog.stats(store.read_tables(spark, root)).select(*[F.col(c).alias(f"exact_{c}") for c in ("traces", "metrics", "services")])
    both = stored.approximate_stats(spark, root).withColumn("_one", F.lit(1)).join(exact.withColumn("_one", F.lit(1)), "_one")
    near = lambda c: (F.abs(F.col(c) - F.col(f"exact_{c}")) <= 0.05 * F.col(f"exact_{c}")).alias(f"{c}_near")
    return both.select("spans", "logs", "metric_points", "earliest_ns", "latest_ns", near("traces"), near("metrics"), near("services"))


on_logs("q3_logs_list", lambda df: log_ops.logs_list(df, limit=300, severity="error", q="user").select(
    "time_ns", "service_name", "severity_text", "body", "trace_id", "total"))
on_points("q4_metrics_list", lambda df: metrics.metrics_list(df, q="app", service="svc-1"))
on_points("q5_metric_detail", lambda df: metrics.metric_detail(df, GAUGE, service="svc-2", limit=20000).points.select(
    "service_name", "series_attributes", "resource_attributes", "ts_ns", "value_double", "value_int"))
on_points("q5_metric_metadata", lambda df: metrics.metric_detail(df, DURATION).metadata)
on_all("q6_services", catalog.service_rollup)
on_all("q7_stats", catalog.stats)
on_all("q8_schema", catalog.schema_listing)


@query("q9_console")
def _console(spark, sf):
    console.register_views(tables.signal_tables(spark, sf))
    return console.console_frame(spark, "SELECT service_name, count(*) AS n, max(end_ns) AS last_ns FROM spans GROUP BY service_name ORDER BY n DESC;")


on_all("q10_attribute_options", lambda t: catalog.attribute_options(t, "metric_points", "service.instance.id", resource=True))
on_all("q10_input_options", lambda t: panels.input_options(t, "loadtest", "route"))


@query("q11_dashboard_run")
def _dashboard(spark, sf):
    t = tables.signal_tables(spark, sf)
    run = panels.run_dashboard(t, "dotnet", service="svc-1", route="/view", max_rows=None)
    return run["rate"].join(run["errors"], "ts").join(run["p95"], "ts")


@query("q11_custom_panel")
def _custom(spark, sf):
    console.register_views(tables.signal_tables(spark, sf))
    return panels.run_custom_panel(spark, """
        SELECT service_name, count(*) AS n FROM spans
        WHERE (:service IS NULL OR service_name = :service) AND (:name IS NULL OR span_name = :name)
          AND start_ns BETWEEN :from_ns AND :to_ns GROUP BY service_name""", *filters.time_range("all"), service="", name="view")


# ------------------------------------------------------------ histograms, counters, rates

on_points("h1_histogram_percentiles", lambda df: histograms.histogram_percentiles(df, DURATION))
on_points("h1_per_series", lambda df: histograms.histogram_percentiles(
    df, DURATION, HOUR, series_keys=("service_name", "series_attributes")))
on_points("h1b_percentile_open", lambda df: examples.latency_p95(df, DURATION).withColumn(
    "p95_s", F.nullif("p95_s", F.lit(float("inf")))))
on_points("h2_latency_heatmap", lambda df: histograms.latency_heatmap(df, DURATION))
on_points("h3_counter_rate", lambda df: counters.counter_rate(df, DURATION))
on_points("h4_increase_total", lambda df: counters.increase_total(df, DURATION))
on_points("h5_increase_by_endpoint", lambda df: counters.increase_by(df, DURATION, "name", "endpoint"))
on_points("h5_increase_by_error", lambda df: counters.increase_by(df, DURATION, "error.type", "error_type", "(ok)"))
on_points("h6_endpoint_stats", lambda df: counters.endpoint_stats(df, DURATION))
on_points("h7_rate_delta", lambda df: counters.rate(df, DELTA, HOUR))
on_points("h7_rate_cumulative", lambda df: counters.rate(df, DURATION, HOUR))
on_points("h8_gauge_series", lambda df: counters.gauge_series(df, GAUGE))
on_points("h8_gauge_latest", lambda df: counters.gauge_series(df, GAUGE, latest=True))
on_spans("h9_span_rate", red.span_rate)
on_spans("h10_span_error_share", red.span_error_share)
on_spans("h11_span_p95", red.span_quantile)
on_spans("h12_top_routes", red.top_routes)

# ------------------------------------------------------------ panels and examples

_METRIC_OF = {"loadtest": {"users_now": GAUGE, "users": GAUGE}, "dotnet": {"kestrel": GAUGE}, "python": {"active": GAUGE}}
_SPAN_PANELS = {"rate", "p95", "routes"}
_INPUTS = {"loadtest": {"service": "svc-1"}, "dotnet": {"service": "svc-2"}, "python": {}}
for _dash in panels.DASHBOARDS.values():
    for _panel in _dash.panels:
        _args = dict(_INPUTS[_dash.name])
        _span_panel = _dash.name != "loadtest" and _panel.id in {*_SPAN_PANELS, "errors"}
        if not _span_panel:
            _args["metric_name"] = _METRIC_OF[_dash.name].get(_panel.id, DURATION)
        on_all(f"d_{_dash.name}_{_panel.id}",
               lambda t, d=_dash.name, p=_panel.id, args=_args: panels.run_panel(t, d, p, *filters.time_range("all"), **args))

on_spans("e1_spans_by_service", examples.spans_by_service)
on_spans("e2_p95_by_service", examples.p95_by_service)
on_spans("e3_error_traces", examples.error_traces)
on_spans("e4_slowest_spans", examples.slowest_spans)
on_logs("e5_logs_by_severity", examples.logs_by_severity)
on_logs("e6_recent_error_logs", examples.recent_error_logs)
on_points("e7_gauge_values", examples.gauge_values)
on_points("e8_histogram_means", examples.histogram_means)
on_points("e9_users_over_time", lambda df: examples.users_over_time(df, GAUGE))
on_points("e10_latency_p95", lambda df: examples.latency_p95(df, DURATION).withColumn("p95_s", F.nullif("p95_s", F.lit(float("inf")))))
on_points("e11_requests_per_second", lambda df: examples.requests_per_second(df, DURATION))

# ------------------------------------------------------------ result shapes

on_points("c1_point_value", lambda df: df.select("metric_name", "service_name", "series_attributes", "ts_ns", metrics.point_value(df).alias("v")))


@query("c2_series_wide")
def _wide(spark, sf):
    keys = [f"svc-{s}|host=h-{h}" for s in range(5) for h in range(2)]
    wide = metrics.series_wide(tables.metric_points(spark, sf), GAUGE, keys)
    return wide.select("t_ms", *[F.col(f"`{k}`").alias(k.replace("-", "").replace("|host=", "_")) for k in keys])


on_points("c3_histogram_buckets", lambda df: metrics.histogram_buckets(df, DURATION))
on_points("c4_exponential_buckets", lambda df: metrics.exponential_buckets(df, EXPONENTIAL).withColumn(
    "upper_bound", round_to(F.col("upper_bound"), 6)))
on_points("c5_summary_quantiles", lambda df: metrics.summary_quantiles(df, SUMMARY))
on_spans("c6_waterfall", lambda df: traces.waterfall(df).select("trace_id", "span_id", "depth", "left_pct", "width_pct"), parents=True)
on_points("c7_line", lambda df: shaping.line(histograms.histogram_percentiles(df, DURATION)).rows)
on_spans("c8_scatter", lambda df: shaping.scatter(df.orderBy("start_ns").select("start_ns", "duration_ms", "status_code", "span_name")).rows)
on_spans("c9_bar", lambda df: shaping.bar(red.top_routes(df)).rows)
on_spans("c10_value_histogram", lambda df: shaping.value_histogram(df, "duration_ms"))
on_points("c11_heat_grid", lambda df: shaping.heat_grid(histograms.latency_heatmap(df, DURATION), "ts", "y", "weight"))
on_points("c12_last_numeric", lambda df: shaping.last_numeric(filters.filter_points(df, GAUGE), ["ts_ns", "service_name"], "value_double"))
on_spans("c13_span_events", lambda df: shaping.span_events(df))
on_spans("c13_span_links", lambda df: shaping.span_links(df))
on_spans("c14_attribute_rows", lambda df: shaping.attribute_rows(df, ["span_id"], "span_attributes", "resource_attributes"))

# ------------------------------------------------------------ streams


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    raw = (spark.readStream.schema(tables.EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf))
    return tables.keyed_events(raw)


def _run(started) -> None:
    started.awaitTermination()


@query("t1_stream_ingest")
def _ingest(spark, sf):
    root, mark = scratch_path(spark, "stream"), scratch_path(spark, "mark")
    _run(ingest.start_ingest(feed.trace_requests(_event_stream(spark, sf)), root, "spans", mark))
    return store.read_table(spark, root, "spans").drop("event_date")


for _key, _table in (("t1_stream_logs", "log_records"), ("t1_stream_metrics", "metric_points")):
    @query(_key)
    def _ingest_one(spark, sf, table=_table):
        """Requests as several files, two to a micro-batch, flattened into the store and folded there."""
        source, root = scratch_path(spark, "requests"), scratch_path(spark, "stream")
        feed.REQUESTS[table](widen(tables.events(spark, sf))).repartition(4).write.text(source)
        lines = spark.readStream.option("maxFilesPerTrigger", 2).text(source)
        _run(ingest.start_ingest(lines, root, table, scratch_path(spark, "mark")))
        store.compact(spark, root, table)
        found = store.read_table(spark, root, table).drop("event_date")
        return found if table == "log_records" else found.groupBy("metric_name", "metric_type", "service_name").agg(
            F.count(F.lit(1)).alias("points"), F.max("ts_ns").alias("last_ns"))


@query("t2_stream_red")
def _stream_red(spark, sf):
    path = scratch_path(spark, "red")
    _run(live.write_versions(live.span_red(tables.spans_from(_event_stream(spark, sf))), path, scratch_path(spark, "mark")))
    return live.latest(spark, path, ["ts"])


@query("t3_stream_increase")
def _stream_increase(spark, sf):
    """The cumulative points, written out and streamed back in two micro-batches with a restart between them."""
    source, path = scratch_path(spark, "points"), scratch_path(spark, "increase")
    kept = counters.observed(tables.metric_points(spark, sf), DURATION).select(
        "service_name", "resource_attributes", "series_attributes", "ts_ns", "hist_count")
    # Files of many tasks; the stream is started anew for the second half of the time.
    half, mark = kept.agg(F.percentile_approx("ts_ns", 0.5)).first()[0], scratch_path(spark, "mark")
    for part in (F.col("ts_ns") <= half, F.col("ts_ns") > half):
        kept.where(part).write.mode("append").parquet(source)
        _run(live.start_increases(spark.readStream.schema(kept.schema).parquet(source), path, mark))
    return spark.read.parquet(f"{path}/rows").select("service_name", "series_attributes", "ts_ns", "hist_count", "inc_hist_count")


@query("t4_stream_traces")
def _stream_traces(spark, sf):
    path = scratch_path(spark, "traces")
    _run(live.write_versions(live.partial_summaries(tables.spans_from(_event_stream(spark, sf))), path, scratch_path(spark, "mark")))
    return live.merge_summaries(live.latest(spark, path, ["trace_id", "window_start"]))


@query("t4_stream_sessions")
def _stream_sessions(spark, sf):
    """Trace summaries by session of a day without spans, closed by a span of a later time."""
    source, path, mark = (scratch_path(spark, n) for n in ("spans", "sessions", "mark"))
    spans = tables.spans(spark, sf)
    later = F.lit(2_000_000_000_000_000_000).cast("bigint")
    closing = spans.limit(1).withColumns({"trace_id": F.lit(""), "start_ns": later, "end_ns": later})
    for part in (spans, closing):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(spans.schema).parquet(source)
        _run(live.write_versions(keyed.session_summaries(stream, "1 day"), path, mark, mode="append"))
    return live.latest(spark, path, ["trace_id", "start_ns"])


@query("t5_stream_all_counts")
def _stream_all_counts(spark, sf):
    """Rows of all three signals; metric points come as a stream of stored files."""
    source, path = scratch_path(spark, "points"), scratch_path(spark, "counts")
    points = tables.metric_points(spark, sf)
    points.select("metric_name", "ts_ns").write.parquet(source)
    signals = {"spans": tables.spans_from(_event_stream(spark, sf)), "log_records": tables.logs_from(_event_stream(spark, sf)),
               "metric_points": spark.readStream.schema("metric_name string, ts_ns bigint").parquet(source)}
    _run(live.write_versions(live.signal_counts(signals), path, scratch_path(spark, "mark"), mode="complete"))
    return live.latest(spark, path, ["signal"])


@query("t5_stream_counts")
def _stream_counts(spark, sf):
    path = scratch_path(spark, "counts")
    signals = {"spans": tables.spans_from(_event_stream(spark, sf)), "log_records": tables.logs_from(_event_stream(spark, sf))}
    _run(live.write_versions(live.signal_counts(signals), path, scratch_path(spark, "mark"), mode="complete"))
    return live.latest(spark, path, ["signal"])
