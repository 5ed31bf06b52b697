"""OTLP/JSON export requests made from the ``events`` table, one request per event.

Feeds the flatteners in tests and registered queries. Attribute lists are out of
order, hold a repeated key and, on some rows, nested values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import SPAN_ID, TRACE_ID

_NESTED = ('{"key":"tags","value":{"arrayValue":{"values":[{"intValue":"1"},{"stringValue":"b"},{"kvlistValue":{"values":'
           '[{"key":"z","value":{"boolValue":true}},{"key":"a","value":{"doubleValue":2.5}}]}}]}}},')


def _resource(eid: Column) -> Column:
    named = F.when(eid % 13 == 0, F.lit("")).otherwise(
        F.format_string('{"key":"service.name","value":{"stringValue":"%s"}},', F.col("svc")))
    return F.concat(F.lit('"resource":{"attributes":['), named,
                    F.format_string('{"key":"service.instance.id","value":{"stringValue":"%s"}}]}', F.col("inst")))


_SCOPE = '"scope":{"name":"app","version":"1.0"},"schemaUrl":""'


def _request(resources: str, scopes: str, records: str, record: Column) -> Column:
    """A request with one record, next to a scope and a resource that hold none."""
    return F.concat(
        F.lit('{"' + resources + '":[{'), _resource(F.col("event_id")),
        F.lit(',"schemaUrl":"http://schema/r","' + scopes + '":[{' + _SCOPE + ',"' + records + '":['), record,
        F.lit(']},{"scope":{"name":"idle"},"' + records + '":[]}]},{"' + scopes + '":[]}]}')).alias("value")


def trace_requests(ev: DataFrame) -> DataFrame:
    eid, ns = F.col("event_id"), F.col("us") * 1000
    code = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 0).otherwise(1)
    record = F.concat(
        F.format_string('{"traceId":"%s","spanId":"%s","traceState":"%s","name":"%s","kind":%d,', F.upper(F.expr(TRACE_ID)),
                        F.expr(SPAN_ID), F.when(eid % 11 == 0, "k=v").otherwise(""), F.col("event_type"), eid % 6),
        F.when(eid % 2 == 1, F.format_string('"parentSpanId":"%s",', F.lpad(F.lower(F.hex(eid)), 16, "0"))).otherwise(""),
        F.format_string('"startTimeUnixNano":"%d","endTimeUnixNano":"%d",', ns,
                        ns + F.floor(F.col("value") * 1000).cast("bigint") * 1000),
        F.lit('"attributes":['),
        F.when(eid % 4 == 0, F.lit("")).otherwise(F.concat(
            F.lit('{"key":"n","value":{"intValue":"99"}},'), F.when(eid % 10 == 1, F.lit(_NESTED)).otherwise(""),
            F.format_string('{"key":"n","value":{"intValue":"%d"}},{"key":"http.route","value":{"stringValue":"/%s"}}',
                            eid % 7, F.col("event_type")))),
        F.lit('],"events":['),
        F.when(eid % 5 == 0, F.format_string(
            '{"timeUnixNano":"%d","name":"evt.%s","attributes":[{"key":"k","value":{"intValue":%d}}]}', ns, F.col("event_type"), eid % 9))
        .otherwise(""),
        F.format_string('],"status":{"code":%d,"message":"%s"},"flags":1}', code,
                        F.when(F.col("event_type") == "error", "failed").otherwise("")))
    return ev.select(_request("resourceSpans", "scopeSpans", "spans", record))


def log_requests(ev: DataFrame) -> DataFrame:
    eid, ns = F.col("event_id"), F.col("us") * 1000
    record = F.concat(
        F.format_string('{"timeUnixNano":"%d","observedTimeUnixNano":"%d","severityNumber":%d,"severityText":"%s",', ns,
                        F.when(eid % 3 == 0, 0).otherwise(ns + 1_000_000), F.when(F.col("event_type") == "error", 17).otherwise(9),
                        F.when(F.col("event_type") == "error", "ERROR").otherwise("")),
        F.format_string('"body":{"stringValue":"%s by \\"user\\" %d"},', F.col("event_type"), F.col("user_id")),
        F.format_string('"attributes":[{"key":"v","value":{"doubleValue":%d.5}},{"key":"ok","value":{"boolValue":%s}}],',
                        eid % 8, F.when(eid % 2 == 0, "true").otherwise("false")),
        F.when(eid % 2 == 0, F.format_string('"traceId":"%s","spanId":"%s"', F.expr(TRACE_ID), F.expr(SPAN_ID)))
        .otherwise('"traceId":"","spanId":""'), F.lit("}"))
    return ev.select(_request("resourceLogs", "scopeLogs", "logRecords", record))


def metric_requests(ev: DataFrame) -> DataFrame:
    """One request per event; the metric kind goes round by ``event_id``, every sixth has no data."""
    eid, ns = F.col("event_id"), F.col("us") * 1000
    point = F.format_string(
        '{"attributes":[{"key":"host","value":{"stringValue":"h-%d"}}],"startTimeUnixNano":"%d","timeUnixNano":"%d",',
        eid % 2, F.when(eid % 3 == 0, 0).otherwise(ns - 1_000_000_000), ns)
    number = F.when(eid % 2 == 0, F.format_string('"asDouble":%d.25}', eid % 10)).otherwise(
        F.format_string('"asInt":"%d"}', eid % 10))
    bucket = F.format_string('"count":"%d","sum":%d.5,"min":0.5,"max":9.0,"explicitBounds":[5.0,"Infinity"],"bucketCounts":["%d","1","0"],'
                             '"exemplars":[{"timeUnixNano":"%d","asInt":"3","spanId":"%s","traceId":""}]}',
                             eid % 7 + 1, eid % 5, eid % 7, ns, F.expr(SPAN_ID))
    exponential = F.format_string('"count":"%d","scale":1,"zeroCount":"%d","positive":{"offset":-1,"bucketCounts":["%d","2"]}}',
                                  eid % 7 + 2, eid % 3, eid % 7)
    summary = F.format_string('"count":"%d","sum":%d.5,"quantileValues":[{"quantile":0.5,"value":%d.25},{"quantile":1,"value":"Infinity"}],"flags":3}',
                              eid % 9, eid % 4, eid % 6)
    shape = lambda field, body, extra="": F.concat(
        F.lit(f'"{field}":{{{extra}"dataPoints":['), point, body, F.lit("]}"))
    data = (F.when(eid % 6 == 0, shape("gauge", number))
            .when(eid % 6 == 1, shape("sum", number, '"aggregationTemporality":2,"isMonotonic":true,'))
            .when(eid % 6 == 2, shape("histogram", bucket, '"aggregationTemporality":2,'))
            .when(eid % 6 == 3, shape("exponentialHistogram", exponential, '"aggregationTemporality":1,'))
            .when(eid % 6 == 4, shape("summary", summary)))
    record = F.concat(F.format_string('{"name":"m.%d","unit":"","description":"d"', eid % 6),
                      F.coalesce(F.concat(F.lit(","), data), F.lit("")), F.lit("}"))
    return ev.select(_request("resourceMetrics", "scopeMetrics", "metrics", record))


REQUESTS = {"spans": trace_requests, "log_records": log_requests, "metric_points": metric_requests}
