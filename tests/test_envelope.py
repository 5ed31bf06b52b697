"""Flattening: the end-to-end scenario and edge cases."""

import json

from pyspark.sql import functions as F

from signalmill.operators import catalog, logs, metrics, traces
from signalmill.plans.console import ConsoleError, register_views, run_query
from signalmill.sources.envelope import flatten_logs, flatten_metrics, flatten_traces

NOW = 1_700_000_000_000_000_000
RESOURCE = {"attributes": [{"key": "service.name", "value": {"stringValue": "e2e-service"}}]}
SCOPE = {"name": "e2e-scope", "version": "1.0"}
TRACE, ROOT, CHILD = "01" * 16, "02" * 8, "03" * 8


def lines(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def attr(key, **value):
    return {"key": key, "value": value}


def trace_doc(*spans, resource=RESOURCE, **scope):
    return {"resourceSpans": [{"resource": resource, "scopeSpans": [{"scope": SCOPE, "spans": list(spans), **scope}]}]}


def scenario(spark):
    spans = flatten_traces(lines(spark, trace_doc(
        {"traceId": TRACE, "spanId": ROOT, "name": "GET /users", "kind": 2, "startTimeUnixNano": str(NOW),
         "endTimeUnixNano": str(NOW + 50_000_000), "attributes": [attr("http.route", stringValue="/users")],
         "events": [{"timeUnixNano": str(NOW + 1000), "name": "cache.miss", "attributes": []}], "status": {"code": 1}},
        {"traceId": TRACE, "spanId": CHILD, "parentSpanId": ROOT, "name": "SELECT users", "kind": 3,
         "startTimeUnixNano": str(NOW + 10_000_000), "endTimeUnixNano": str(NOW + 40_000_000),
         "status": {"code": 2, "message": "boom"}})))
    log_rows = flatten_logs(lines(spark, {"resourceLogs": [{"resource": RESOURCE, "scopeLogs": [{"scope": SCOPE, "logRecords": [
        {"timeUnixNano": str(NOW), "observedTimeUnixNano": str(NOW + 5), "severityNumber": 17, "severityText": "ERROR",
         "body": {"stringValue": "db connection refused"}, "traceId": TRACE, "spanId": CHILD},
        {"timeUnixNano": str(NOW + 10), "severityNumber": 9, "severityText": "INFO", "body": {"stringValue": "request succeeded"},
         "traceId": TRACE, "spanId": ROOT}]}]}]}))
    points = flatten_metrics(lines(spark, {"resourceMetrics": [{"resource": RESOURCE, "scopeMetrics": [{"scope": SCOPE, "metrics": [
        {"name": "requests", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": [
            {"timeUnixNano": str(NOW), "asDouble": 42.5}]}},
        {"name": "latency", "unit": "ms", "histogram": {"aggregationTemporality": 2, "dataPoints": [
            {"timeUnixNano": str(NOW), "count": "7", "sum": 123.0, "bucketCounts": ["1", "2", "4"], "explicitBounds": [5.0, 10.0],
             "min": 1.0, "max": 30.0}]}}]}]}]}))
    return {"spans": spans, "log_records": log_rows, "metric_points": points}


def test_end_to_end_scenario(spark):
    t = scenario(spark)
    s = catalog.stats(t).first()
    assert (s["spans"], s["traces"], s["logs"], s["metric_points"], s["services"]) == (2, 1, 2, 2, 1)
    listed = traces.traces_list(t["spans"], service="e2e-service", errors_only=True).collect()
    assert [(r["total"], r["span_count"], r["error_count"], r["root_name"]) for r in listed] == [(1, 2, 1, "GET /users")]
    assert len(traces.traces_list(t["spans"], q="users").collect()) == 1
    assert len(traces.traces_list(t["spans"], q="nonexistent").collect()) == 0
    first, second = traces.trace_detail(t["spans"], TRACE).spans.collect()
    assert second["parent_span_id"] == first["span_id"]
    assert json.loads(first["span_attributes"]) == {"http.route": "/users"}
    assert json.loads(first["events"])[0]["name"] == "cache.miss"
    assert first["duration_ms"] == 50.0
    assert traces.trace_detail(t["spans"], "ff").summary.isEmpty()
    found = logs.logs_list(t["log_records"], severity="error").collect()
    assert [r["body"] for r in found] == ['"db connection refused"']
    assert logs.logs_list(t["log_records"], q="succeeded").first()["observed_time_ns"] is None
    assert logs.logs_list(t["log_records"], trace_id=TRACE).count() == 2
    assert [r["metric_type"] for r in metrics.metrics_list(t["metric_points"], q="latency").collect()] == ["histogram"]
    point = metrics.metric_detail(t["metric_points"], "latency").points.first()
    assert (point["hist_count"], point["hist_sum"], point["hist_bounds"], point["hist_bucket_counts"]) == (7, 123.0, "[5.0,10.0]", "[1,2,4]")
    assert [(r["service_name"], r["span_count"]) for r in catalog.service_rollup(t).collect()] == [("e2e-service", 2)]
    register_views(t)
    assert run_query(spark, "SELECT service_name, count(*) AS n FROM spans GROUP BY 1").rows == [{"service_name": "e2e-service", "n": 2}]
    capped = run_query(spark, "SELECT id FROM range(100)", 10)
    assert len(capped.rows) == 10 and capped.truncated
    try:
        run_query(spark, "DELETE FROM spans")
        raise AssertionError("write was accepted")
    except ConsoleError:
        pass


def test_attribute_values(spark):
    doc = trace_doc({"traceId": "AB", "spanId": "cd", "attributes": [
        attr("z", intValue="5"), attr("a", doubleValue=1.0), attr("z", intValue=6), attr("b", boolValue=True),
        attr("bytes", bytesValue="AQI="), attr("none"), attr("inf", doubleValue="Infinity"), attr("big", doubleValue=1e16),
        attr("quote", stringValue='say "x"\n\\ é'), attr("empty", stringValue=""), {"key": "bare"},
        attr("list", arrayValue={"values": [{"intValue": "1"}, {"doubleValue": 0.5}, {}, {"arrayValue": {}},
                                            {"kvlistValue": {"values": [attr("k", stringValue="v"), attr("c", boolValue=False)]}}]})]})
    row = flatten_traces(lines(spark, doc)).first()
    assert row["trace_id"] == "ab" and row["parent_span_id"] is None
    assert row["span_attributes"] == (
        '{"a":1.0,"b":true,"bare":null,"big":1e16,"bytes":"0102","empty":"","inf":"inf",'
        '"list":[1,0.5,null,[],{"c":false,"k":"v"}],"none":null,"quote":"say \\"x\\"\\n\\\\ é","z":6}')


def test_double_texts_are_the_same_inside_lists(spark):
    values = [0.0, -0.0, 1.0, 0.1, 1e-5, 1.5e-5, 9.99e-4, 1e-6, 123456.789, 1e7, 12345678.5, 1.2e15, 1e16, 1.7976931348623157e308]
    docs = [trace_doc({"attributes": [attr("s", doubleValue=v), attr("l", arrayValue={"values": [{"doubleValue": v}]})]}) for v in values]
    got = [r["span_attributes"] for r in flatten_traces(lines(spark, *docs)).collect()]
    for text, v in zip(got, values):
        parsed = json.loads(text)
        single, listed = text.split('"s":')[1][:-1], text.split("[")[1].split("]")[0]
        assert single == listed, text
        assert parsed["s"] == v == parsed["l"][0]
    assert "1e7" not in got[9] and '"s":10000000.0' in got[9] and '"s":0.00001}' in got[4]


def test_resource_and_times(spark):
    docs = [
        trace_doc({"name": "clamped", "startTimeUnixNano": "18446744073709551615", "endTimeUnixNano": "5"}, resource={"attributes": []}),
        trace_doc({"name": "number", "startTimeUnixNano": 7, "endTimeUnixNano": 9}, resource={"attributes": [attr("service.name", intValue="3")]}),
        trace_doc({"name": "null"}, resource={"attributes": [attr("service.name")]}, schemaUrl="http://scope"),
        trace_doc(), {"resourceSpans": []}, {}, "not json",
        {"resourceSpans": [{"schemaUrl": "http://res", "scopeSpans": [{"spans": [{"name": "bare"}]}]}]}]
    got = {r["span_name"]: r for r in flatten_traces(lines(spark, *docs)).collect()}
    assert set(got) == {"clamped", "number", "null", "bare"}
    assert got["clamped"]["start_ns"] == 2 ** 63 - 1 and got["clamped"]["duration_ms"] == 0.0
    assert got["clamped"]["service_name"] == "unknown_service" and got["clamped"]["resource_attributes"] is None
    assert got["number"]["service_name"] == "3" and got["number"]["start_ns"] == 7
    assert got["null"]["service_name"] == "unknown_service" and got["null"]["schema_url"] == "http://scope"
    assert got["bare"]["schema_url"] == "http://res" and got["bare"]["scope_name"] is None


def test_metric_kinds(spark):
    doc = {"resourceMetrics": [{"resource": RESOURCE, "scopeMetrics": [{"metrics": [
        {"name": "none"}, {"name": "empty", "gauge": {"dataPoints": []}},
        {"name": "unset", "gauge": {"dataPoints": [{"timeUnixNano": "1"}]}, "metadata": [attr("m", intValue="1")]},
        {"name": "wrap", "histogram": {"dataPoints": [{"count": "18446744073709551615", "timeUnixNano": "1", "explicitBounds": [1, "Infinity"],
                                                       "bucketCounts": ["1", "2"]}]}},
        {"name": "s", "summary": {"dataPoints": [{"timeUnixNano": "1", "flags": 9, "quantileValues": []}]}},
        {"name": "e", "exponentialHistogram": {"dataPoints": [{"timeUnixNano": "1", "scale": 2, "positive": {"offset": 1, "bucketCounts": ["3"]}}]}}]}]}]}
    got = {r["metric_name"]: r for r in flatten_metrics(lines(spark, doc)).collect()}
    assert set(got) == {"unset", "wrap", "s", "e"}
    assert got["unset"]["value_double"] is None and got["unset"]["value_int"] is None and got["unset"]["metric_metadata"] == '{"m":1}'
    assert got["unset"]["aggregation_temporality"] is None and got["unset"]["start_ns"] is None
    assert got["wrap"]["hist_count"] == -1 and got["wrap"]["hist_bounds"] == '[1.0,"inf"]' and got["wrap"]["aggregation_temporality"] == 0
    assert got["s"]["flags"] == 0 and got["s"]["summary_quantiles"] is None and got["s"]["summary_sum"] == 0.0
    assert got["e"]["exp_buckets"] == '{"negative":null,"positive":{"bucket_counts":[3],"offset":1}}'


def test_log_bodies(spark):
    records = [{"body": {"kvlistValue": {"values": [attr("b", intValue="2"), attr("a", stringValue="x")]}}}, {"body": {}}, {},
               {"body": {"intValue": "4"}, "traceId": "", "severityText": ""}]
    doc = {"resourceLogs": [{"scopeLogs": [{"logRecords": records}]}]}
    got = [(r["body"], r["trace_id"], r["severity_text"], r["severity_number"]) for r in flatten_logs(lines(spark, doc)).collect()]
    assert got == [('{"a":"x","b":2}', None, None, 0), ("null", None, None, 0), (None, None, None, 0), ("4", None, None, 0)]
