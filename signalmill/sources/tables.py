"""Signal tables derived from the ``events`` table of a data folder.

Every event becomes a span and a log record and feeds five metrics, one of each
metric kind plus a delta histogram. The expressions are the fixed test mapping;
see FIXTURES.md.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.timeutil import HOUR, bucket_start, ntz_micros
from ..operators.skew import with_previous
from ..schemas import LOG_RECORDS, METRIC_POINTS, SPANS

EVENT_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                "value double, props string")
HOUR_US = HOUR // 1000

# The mapping from events to signals, as SQL expressions over ``keyed_events``.
TRACE_ID = "lpad(lower(hex(user_id * 1000 + floor((us - 1704067200000000) / 86400000000))), 32, '0')"
SPAN_ID = "lpad(lower(hex(event_id + 1)), 16, '0')"
RESOURCE = """format_string('{"service.instance.id":"%s","service.name":"%s"}', inst, svc)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def keyed_events(raw: DataFrame) -> DataFrame:
    """Events with ``us`` (epoch microseconds), ``svc`` and ``inst``."""
    return raw.withColumn("us", ntz_micros(F.col("ts"))).selectExpr(
        "*", "concat('svc-', event_id % 5) AS svc", "concat('i-', event_id % 3) AS inst")


def _select(df: DataFrame, schema, **given: str) -> DataFrame:
    """Table columns in order from SQL expressions; absent ones are typed NULL."""
    return df.selectExpr(*[f"CAST({given.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields])


def spans_from(ev: DataFrame) -> DataFrame:
    """Spans without a parent; also for streams."""
    end_us = "(us + floor(value * 1000))"
    return _select(
        ev, SPANS, trace_id=TRACE_ID, span_id=SPAN_ID, span_name="event_type", span_kind="event_id % 6",
        start_ns="us * 1000", end_ns=f"{end_us} * 1000", duration_ms=f"({end_us} * 1000 - us * 1000) / 1e6D",
        service_name="svc", scope_name="'app'", scope_version="'1.0'", resource_attributes=RESOURCE,
        span_attributes="""CASE WHEN event_id % 4 <> 0 THEN format_string('{"http.route":"/%s","n":%d}', event_type, event_id % 7) END""",
        status_code="CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 0 ELSE 1 END",
        status_message="CASE WHEN event_type = 'error' THEN 'failed' END",
        events="""CASE WHEN event_id % 5 = 0 THEN format_string(
            '[{"attributes":{"k":%d},"dropped_attributes_count":0,"name":"evt.%s","time_ns":"%d"}]', event_id % 9, event_type, us * 1000) END""",
        links=f"""CASE WHEN event_id % 7 = 0 THEN format_string(
            '[{{"attributes":{{}},"dropped_attributes_count":0,"flags":1,"span_id":"%s","trace_id":"%s","trace_state":""}}]', {SPAN_ID}, {TRACE_ID}) END""",
        dropped_attributes_count="0", dropped_events_count="0", dropped_links_count="0", flags="1")


def spans(spark: SparkSession, sf_dir: str, parents: bool = False) -> DataFrame:
    """Spans; with ``parents`` each span's parent is the span before it in its trace."""
    df = spans_from(events(spark, sf_dir))
    if not parents:
        return df
    linked = with_previous(df.drop("parent_span_id"), ["trace_id"], ["start_ns", "span_id"], ["span_id"],
                           bucket_start(F.col("start_ns"), HOUR))
    return linked.withColumnRenamed("prev_span_id", "parent_span_id").select(*SPANS.names)


def logs_from(ev: DataFrame) -> DataFrame:
    return _select(
        ev, LOG_RECORDS, time_ns="us * 1000", observed_time_ns="CASE WHEN event_id % 3 <> 0 THEN us * 1000 + 1000000 END",
        severity_text="""CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO'
            WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'TRACE' END""",
        severity_number="""CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9
            WHEN 'view' THEN 5 WHEN 'click' THEN 1 END""",
        service_name="svc", scope_name="'app'", scope_version="'1.0'",
        body="""format_string('"%s by user %d"', event_type, user_id)""",
        trace_id=f"CASE WHEN event_id % 2 = 0 THEN {TRACE_ID} END", span_id=f"CASE WHEN event_id % 2 = 0 THEN {SPAN_ID} END",
        event_name="CASE WHEN event_id % 10 = 0 THEN concat('evt.', event_type) END", log_attributes="props",
        resource_attributes=RESOURCE, flags="0")


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from(events(spark, sf_dir))


def _hourly(ev: DataFrame) -> DataFrame:
    """Counts per event type, service and hour: sums, maximum and four latency buckets."""
    return (ev.selectExpr("event_type", "svc", "event_id % 5 AS s", f"us - us % {HOUR_US} AS hour", "value AS v")
            .groupBy("event_type", "svc", "s", "hour")
            .agg(*map(F.expr, ("count(1) AS n", "sum(floor(v * 100)) AS cents", "max(v) AS mx", "count_if(v <= 5) AS b0",
                               "count_if(v > 5 AND v <= 25) AS b1", "count_if(v > 25 AND v <= 100) AS b2", "count_if(v > 100) AS b3"))))


def _histogram(ev: DataFrame, metric: str, temporality: int) -> DataFrame:
    df = _hourly(ev)
    if temporality == 2:
        # One row per hour is left of each of the 25 series, so the running sums are short.
        run = W.partitionBy("event_type", "svc").orderBy("hour").rowsBetween(W.unboundedPreceding, 0)
        df = df.withColumns({c: F.sum(c).over(run) for c in ("n", "cents", "b0", "b1", "b2", "b3")} | {"mx": F.max("mx").over(run)})
    return _select(
        df, METRIC_POINTS, metric_name=f"'{metric}'", metric_type="'histogram'", metric_unit="'ms'",
        metric_description="'Duration of an event'", aggregation_temporality=str(temporality), service_name="svc",
        resource_attributes="""format_string('{"service.instance.id":"i-%d","service.name":"%s"}', s % 3, svc)""",
        series_attributes="""CASE WHEN event_type = 'error' THEN '{"error.type":"E1","name":"error"}'
            ELSE format_string('{"name":"%s"}', event_type) END""",
        start_ns="hour * 1000", ts_ns=f"hour * 1000 + {HOUR}", hist_count="n", hist_sum="cents / 100.0D", hist_max="mx",
        hist_bounds="'[5.0,25.0,100.0]'", hist_bucket_counts="format_string('[%d,%d,%d,%d]', b0, b1, b2, b3)", flags="0")


def _per_event(ev: DataFrame, metric: str, kind: str, **given: str) -> DataFrame:
    return _select(ev, METRIC_POINTS, metric_name=f"'{metric}'", metric_type=f"'{kind}'", service_name="svc",
                   resource_attributes=RESOURCE, ts_ns="us * 1000", flags="0", **given)


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metric kinds in one frame; a filter on ``metric_name`` leaves one branch of the union."""
    ev = events(spark, sf_dir)
    parts = [
        _per_event(ev, "app.value", "gauge", series_attributes="""format_string('{"host":"h-%d"}', event_id % 2)""",
                   value_double="CASE WHEN event_id % 2 = 0 THEN value END", value_int="CASE WHEN event_id % 2 = 1 THEN floor(value) END"),
        _per_event(ev.where("event_type = 'purchase'"), "app.purchases", "sum", metric_unit="'{purchase}'",
                   aggregation_temporality="1", is_monotonic="true", value_int="1"),
        _histogram(ev, "app.duration", 2), _histogram(ev, "app.duration.delta", 1),
        _per_event(ev.where("event_id % 50 = 0"), "app.latency.exp", "exponential_histogram", aggregation_temporality="2",
                   exp_zero_count="event_id % 3", exp_scale="1", exp_zero_threshold="0.0D",
                   hist_count="event_id % 3 + event_id % 7 + event_id % 11 + 4",
                   exp_buckets="""CASE WHEN event_id % 100 = 0
                       THEN format_string('{"negative":null,"positive":{"bucket_counts":[%d,%d,4],"offset":%d}}',
                                          event_id % 7, event_id % 11, event_id % 4 - 2)
                       ELSE format_string('{"negative":{"bucket_counts":[1,2],"offset":0},"positive":{"bucket_counts":[%d,%d,1],"offset":%d}}',
                                          event_id % 7, event_id % 11, event_id % 4 - 2) END"""),
        _per_event(ev.where("event_id % 50 = 1"), "app.quantiles", "summary", summary_count="event_id % 9",
                   summary_sum="(event_id % 9) * floor(value)",
                   summary_quantiles="""format_string(
                       '[{"quantile":0.99,"value":%d.5},{"quantile":0.5,"value":%d.25},{"quantile":1.0,"value":"inf"}]',
                       floor(value * 2), floor(value))"""),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


class SignalTables(Mapping):
    """The three tables by name, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, parents: bool = False):
        self._build = {"spans": lambda: spans(spark, sf_dir, parents), "log_records": lambda: log_records(spark, sf_dir),
                       "metric_points": lambda: metric_points(spark, sf_dir)}
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._build)

    def __len__(self) -> int:
        return len(self._build)


def signal_tables(spark: SparkSession, sf_dir: str, parents: bool = False) -> Mapping[str, DataFrame]:
    return SignalTables(spark, sf_dir, parents)
