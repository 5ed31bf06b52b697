"""Flattening of OTLP/JSON export requests into the three signal tables.

Input is a frame, batch or stream, with one JSON document per row in ``value``.
Everything runs on built-in functions; only array and map valued attributes,
whose depth has no bound, pass through an Arrow UDF. The helpers here compose
SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.jsonsql import array_text, json_double, object_text, quoted
from ..functions.nested import plain_values
from ..functions.timeutil import MAX_I64
from ..schemas import LOG_RECORDS, METRIC_POINTS, SPANS

UNKNOWN_SERVICE = "unknown_service"

_ANY = ("struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,bytesValue:string,"
        "arrayValue:string,kvlistValue:string>")
_KV = f"array<struct<key:string,value:{_ANY}>>"
_SCOPE = "scope:struct<name:string,version:string>,schemaUrl:string"
_EVENT = f"struct<timeUnixNano:string,name:string,attributes:{_KV},droppedAttributesCount:bigint>"
_LINK = (f"struct<traceId:string,spanId:string,traceState:string,attributes:{_KV},"
         "droppedAttributesCount:bigint,flags:bigint>")
_SPAN = (f"struct<traceId:string,spanId:string,traceState:string,parentSpanId:string,flags:bigint,name:string,kind:int,"
         f"startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},droppedAttributesCount:int,"
         f"events:array<{_EVENT}>,droppedEventsCount:int,links:array<{_LINK}>,droppedLinksCount:int,"
         "status:struct<message:string,code:int>>")
_LOG = (f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_ANY},"
        f"attributes:{_KV},flags:bigint,traceId:string,spanId:string,eventName:string>")
_EXEMPLAR = (f"struct<filteredAttributes:{_KV},timeUnixNano:string,asDouble:string,asInt:string,"
             "spanId:string,traceId:string>")
_BUCKETS = "struct<offset:int,bucketCounts:array<string>>"
# One struct covers the points of all five metric kinds, so one explode reads them all.
_POINT = (f"struct<attributes:{_KV},startTimeUnixNano:string,timeUnixNano:string,asDouble:string,asInt:string,"
          f"exemplars:array<{_EXEMPLAR}>,flags:bigint,count:string,sum:string,min:string,max:string,"
          f"explicitBounds:array<string>,bucketCounts:array<string>,scale:int,zeroCount:string,zeroThreshold:string,"
          f"positive:{_BUCKETS},negative:{_BUCKETS},quantileValues:array<struct<quantile:string,value:string>>>")
_DATA = f"struct<dataPoints:array<{_POINT}>,aggregationTemporality:int,isMonotonic:boolean>"
# Metric kinds by their field in the envelope.
KINDS = {"gauge": "gauge", "sum": "sum", "histogram": "histogram",
         "exponentialHistogram": "exponential_histogram", "summary": "summary"}
_METRIC = (f"struct<name:string,description:string,unit:string,metadata:{_KV},"
           + ",".join(f"{k}:{_DATA}" for k in KINDS) + ">")


def _request(resources: str, scopes: str, records: str, record: str) -> str:
    return (f"struct<{resources}:array<struct<resource:struct<attributes:{_KV}>,schemaUrl:string,"
            f"{scopes}:array<struct<{_SCOPE},{records}:array<{record}>>>>>>")


# ---------------------------------------------------------------- attribute values

def _nested_one(v: str) -> str:
    """Tagged JSON of an array or map valued attribute, NULL for other values."""
    return (f"""coalesce(concat('{{"arrayValue":', {v}.arrayValue, '}}'), concat('{{"kvlistValue":', {v}.kvlistValue, '}}'))""")


def _nested(kvs: str) -> str:
    """The array and map valued attributes of a list, as tagged JSON."""
    return (f"coalesce(transform(filter({kvs}, kv -> kv.value.arrayValue IS NOT NULL OR kv.value.kvlistValue IS NOT NULL), "
            f"kv -> {_nested_one('kv.value')}), array())")


def _with_plain(df: DataFrame, name: str, *lists: str) -> DataFrame:
    """Adds a map from nested values (tagged JSON) to plain JSON text, NULL where a row has none."""
    joined = lists[0] if len(lists) == 1 else f"concat({', '.join(lists)})"
    df = df.withColumn("_found", F.expr(f"array_distinct({joined})"))
    df = df.withColumn("_raws", F.expr("CASE WHEN size(_found) > 0 THEN _found END"))
    df = df.withColumn("_texts", plain_values(F.col("_raws")))
    return df.withColumn(name, F.map_from_arrays("_raws", "_texts")).drop("_found", "_raws", "_texts")


def _any_json(v: str, plain: str) -> str:
    """A tagged value as JSON text; ``null`` when it holds nothing."""
    return (f"CASE WHEN {v}.stringValue IS NOT NULL THEN {quoted(v + '.stringValue')} "
            f"WHEN {v}.intValue IS NOT NULL THEN string(try_cast({v}.intValue AS bigint)) "
            f"WHEN {v}.boolValue IS NOT NULL THEN {v}.boolValue "
            f"WHEN {v}.doubleValue IS NOT NULL THEN {json_double(f'try_cast({v}.doubleValue AS double)')} "
            f"""WHEN {v}.bytesValue IS NOT NULL THEN concat('"', lower(hex(try_to_binary({v}.bytesValue, 'base64'))), '"') """
            f"ELSE coalesce(try_element_at({plain}, {_nested_one(v)}), 'null') END")


def _object(kvs: str, plain: str) -> str:
    """Attribute list as JSON object text: keys sorted, the last of equal keys wins, ``{}`` when empty."""
    key = "coalesce(kv.key, '')"
    keys = f"sort_array(array_distinct(transform({kvs}, kv -> {key})))"
    # The value stands in a one-element list of its own so that it is looked up once per key.
    value = f"element_at(filter({kvs}, kv -> {key} = k), -1).value"
    field = f"concat({quoted('k')}, ':', transform(array({value}), v -> {_any_json('v', plain)})[0])"
    return f"coalesce(concat('{{', array_join(transform({keys}, k -> {field}), ','), '}}'), '{{}}')"


def _attributes(kvs: str, plain: str) -> str:
    """Like ``_object``, NULL when there are no attributes."""
    return f"CASE WHEN size({kvs}) > 0 THEN {_object(kvs, plain)} END"


# ---------------------------------------------------------------- plain fields

def _text(x: str) -> str:
    return f"nullif({x}, '')"


def _hex(x: str) -> str:
    return f"lower(coalesce({x}, ''))"


def _unsigned(x: str) -> str:
    return f"try_cast({x} AS decimal(20,0))"


def _time(x: str) -> str:
    """Unsigned nanoseconds to BIGINT, values above the signed range clamped to its top; absent is 0."""
    return f"bigint(least(coalesce({_unsigned(x)}, 0), {MAX_I64}))"


def _count(x: str) -> str:
    """Unsigned count to BIGINT; values above the signed range wrap around."""
    n = f"coalesce({_unsigned(x)}, 0)"
    return f"bigint(CASE WHEN {n} > {MAX_I64} THEN {n} - {2 ** 64} ELSE {n} END)"


def _double(x: str) -> str:
    return f"try_cast({x} AS double)"


def _int_text(x: str) -> str:
    return f"string(coalesce({x}, 0))"


# ---------------------------------------------------------------- shared levels

def _records(lines: DataFrame, resources: str, scopes: str, records: str, record: str) -> DataFrame:
    """One row per record ``r`` with its resource and scope columns.

    Resource texts are made before the records are exploded, once per resource.
    """
    request = _request(resources, scopes, records, record)
    parsed = lines.select(F.from_json("value", request).alias("req"))
    res = parsed.selectExpr(f"explode(req.{resources}) AS res").selectExpr(
        "coalesce(res.resource.attributes, array()) AS attrs", f"{_text('res.schemaUrl')} AS _url", f"res.{scopes} AS scs")
    res = _with_plain(res, "_rp", _nested("attrs"))
    named = "filter(attrs, kv -> kv.key = 'service.name')"
    service = f"transform({named}, kv -> nullif({_any_json('kv.value', '_rp')}, 'null'))"
    res = res.selectExpr(
        f"""coalesce(trim(BOTH '"' FROM try_element_at({service}, -1)), '{UNKNOWN_SERVICE}') AS service_name""",
        f"{_attributes('attrs', '_rp')} AS resource_attributes", "_url", "explode(scs) AS sc")
    return res.selectExpr(
        "service_name", "resource_attributes", f"{_text('sc.scope.name')} AS scope_name", f"{_text('sc.scope.version')} AS scope_version",
        f"coalesce({_text('sc.schemaUrl')}, _url) AS schema_url", f"explode(sc.{records}) AS r")


def _table(rows: DataFrame, schema, **given: str) -> DataFrame:
    """Table columns in order from SQL expressions; the rest are taken by name."""
    return rows.selectExpr(*[f"CAST({given.get(f.name, f.name)} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields])


# ---------------------------------------------------------------- traces and logs

def flatten_traces(lines: DataFrame) -> DataFrame:
    """Trace requests to rows of the spans table."""
    rows = _records(lines, "resourceSpans", "scopeSpans", "spans", _SPAN)
    inner = lambda items: f"coalesce(flatten(transform({items}, x -> {_nested('x.attributes')})), array())"
    rows = _with_plain(rows, "_plain", _nested("r.attributes"), inner("r.events"), inner("r.links"))
    event = object_text(
        attributes=_object("x.attributes", "_plain"), dropped_attributes_count=_int_text("x.droppedAttributesCount"),
        name=quoted("coalesce(x.name, '')"), time_ns=f"""concat('"', {_time('x.timeUnixNano')}, '"')""")
    link = object_text(
        attributes=_object("x.attributes", "_plain"), dropped_attributes_count=_int_text("x.droppedAttributesCount"),
        flags=_int_text("x.flags"), span_id=quoted(_hex("x.spanId")), trace_id=quoted(_hex("x.traceId")),
        trace_state=quoted("coalesce(x.traceState, '')"))
    listed = lambda items, text: f"CASE WHEN size({items}) > 0 THEN {array_text(f'transform({items}, x -> {text})')} END"
    rows = rows.withColumns({"start_ns": F.expr(_time("r.startTimeUnixNano")), "end_ns": F.expr(_time("r.endTimeUnixNano"))})
    return _table(
        rows, SPANS, trace_id=_hex("r.traceId"), span_id=_hex("r.spanId"), parent_span_id=_text(_hex("r.parentSpanId")),
        trace_state=_text("r.traceState"), span_name="coalesce(r.name, '')", span_kind="coalesce(r.kind, 0)",
        duration_ms="greatest(try_subtract(end_ns, start_ns), 0) / 1e6D", span_attributes=_attributes("r.attributes", "_plain"),
        status_code="coalesce(r.status.code, 0)", status_message=_text("r.status.message"), events=listed("r.events", event),
        links=listed("r.links", link), dropped_attributes_count="coalesce(r.droppedAttributesCount, 0)",
        dropped_events_count="coalesce(r.droppedEventsCount, 0)", dropped_links_count="coalesce(r.droppedLinksCount, 0)",
        flags="coalesce(r.flags, 0)")


def flatten_logs(lines: DataFrame) -> DataFrame:
    """Log requests to rows of the log table; the body is JSON text, quotes included."""
    rows = _records(lines, "resourceLogs", "scopeLogs", "logRecords", _LOG)
    body = f"filter(array({_nested_one('r.body')}), x -> x IS NOT NULL)"
    rows = _with_plain(rows, "_plain", _nested("r.attributes"), body)
    return _table(
        rows, LOG_RECORDS, time_ns=_time("r.timeUnixNano"), observed_time_ns=f"nullif({_time('r.observedTimeUnixNano')}, 0)",
        severity_text=_text("r.severityText"), severity_number="coalesce(r.severityNumber, 0)",
        body=f"CASE WHEN r.body IS NOT NULL THEN {_any_json('r.body', '_plain')} END", trace_id=_text(_hex("r.traceId")),
        span_id=_text(_hex("r.spanId")), event_name=_text("r.eventName"), log_attributes=_attributes("r.attributes", "_plain"),
        flags="coalesce(r.flags, 0)")


# ---------------------------------------------------------------- metrics

def flatten_metrics(lines: DataFrame) -> DataFrame:
    """Metric requests to one row per data point; metrics without data give no row."""
    rows = _records(lines, "resourceMetrics", "scopeMetrics", "metrics", _METRIC)
    kind = "CASE " + " ".join(f"WHEN r.{field} IS NOT NULL THEN '{name}'" for field, name in KINDS.items()) + " END"
    rows = rows.selectExpr("*", f"{kind} AS metric_type", f"coalesce({', '.join('r.' + field for field in KINDS)}) AS d")
    rows = rows.selectExpr("*", "explode(d.dataPoints) AS p")
    inner = f"coalesce(flatten(transform(p.exemplars, x -> {_nested('x.filteredAttributes')})), array())"
    rows = _with_plain(rows, "_plain", _nested("r.metadata"), _nested("p.attributes"), inner)
    number = lambda x: json_double(_double(x))
    exemplar = object_text(
        filtered_attributes=_object("x.filteredAttributes", "_plain"), span_id=quoted(_hex("x.spanId")),
        time_ns=f"""concat('"', {_time('x.timeUnixNano')}, '"')""", trace_id=quoted(_hex("x.traceId")),
        value=f"CASE WHEN x.asDouble IS NOT NULL THEN {number('x.asDouble')} ELSE string(try_cast(x.asInt AS bigint)) END")
    buckets = lambda b: f"CASE WHEN {b} IS NOT NULL THEN " + object_text(
        bucket_counts=array_text(f"coalesce({b}.bucketCounts, array())"), offset=_int_text(f"{b}.offset")) + " END"
    quantile = object_text(quantile=number("coalesce(x.quantile, '0')"), value=number("coalesce(x.value, '0')"))
    listed = lambda items, text: f"CASE WHEN size({items}) > 0 THEN {array_text(f'transform({items}, x -> {text})')} END"
    only = lambda names, value: f"CASE WHEN metric_type IN ({', '.join(repr(n) for n in names)}) THEN {value} END"
    scalar, hist, exp, summary = ("gauge", "sum"), ("histogram",), ("exponential_histogram",), ("summary",)
    both = (*hist, *exp)
    return _table(
        rows, METRIC_POINTS, metric_name="coalesce(r.name, '')", metric_unit=_text("r.unit"), metric_description=_text("r.description"),
        aggregation_temporality=only(("sum", *both), "coalesce(d.aggregationTemporality, 0)"),
        is_monotonic=only(("sum",), "coalesce(d.isMonotonic, false)"), series_attributes=_attributes("p.attributes", "_plain"),
        metric_metadata=_attributes("r.metadata", "_plain"), exemplars=only((*scalar, *both), listed("p.exemplars", exemplar)),
        start_ns=f"nullif({_time('p.startTimeUnixNano')}, 0)", ts_ns=_time("p.timeUnixNano"),
        value_double=only(scalar, _double("p.asDouble")),
        value_int=only(scalar, "if(p.asDouble IS NULL, try_cast(p.asInt AS bigint), NULL)"),
        hist_count=only(both, _count("p.count")), hist_sum=only(both, _double("p.sum")), hist_min=only(both, _double("p.min")),
        hist_max=only(both, _double("p.max")), hist_bounds=only(hist, listed("p.explicitBounds", number("x"))),
        hist_bucket_counts=only(hist, f"CASE WHEN size(p.bucketCounts) > 0 THEN {array_text('p.bucketCounts')} END"),
        exp_zero_count=only(exp, _count("p.zeroCount")), exp_scale=only(exp, "coalesce(p.scale, 0)"),
        exp_zero_threshold=only(exp, f"coalesce({_double('p.zeroThreshold')}, 0.0D)"),
        exp_buckets=only(exp, object_text(negative=buckets("p.negative"), positive=buckets("p.positive"))),
        summary_count=only(summary, _count("p.count")), summary_sum=only(summary, f"coalesce({_double('p.sum')}, 0.0D)"),
        summary_quantiles=only(summary, listed("p.quantileValues", quantile)),
        flags="if(metric_type = 'summary', 0, coalesce(p.flags, 0))")


FLATTEN = {"spans": flatten_traces, "log_records": flatten_logs, "metric_points": flatten_metrics}
