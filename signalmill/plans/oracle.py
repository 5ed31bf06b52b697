"""The same queries as plain DuckDB SQL, written independently of the DataFrame code."""

from __future__ import annotations

from ..schemas import DDL

H = 3_600_000_000_000
HALF_MIN_US, HOUR_US = 30_000_000, 3_600_000_000
T0 = 1_704_067_200_000_000_000
MID0, MID1 = T0 + 120 * H, T0 + 480 * H

EV = """ev AS (SELECT *, epoch_us(ts) AS us, 'svc-' || (event_id % 5) AS svc, 'i-' || (event_id % 3) AS inst FROM events)"""

_TRACE = "lpad(lower(hex(user_id*1000 + (us-1704067200000000)//86400000000)),32,'0')"
_SPAN = "lpad(lower(hex(event_id+1)),16,'0')"
_RES = """'{"service.instance.id":"' || inst || '","service.name":"' || svc || '"}'"""

SPANS = EV + f""", sp0 AS (
  SELECT {_TRACE} AS trace_id, {_SPAN} AS span_id, NULL::VARCHAR AS trace_state, event_type AS span_name,
    (event_id % 6)::INTEGER AS span_kind, us*1000 AS start_ns, us*1000 + floor(value*1000)::BIGINT*1000 AS end_ns,
    svc AS service_name, 'app' AS scope_name, '1.0' AS scope_version, NULL::VARCHAR AS schema_url,
    {_RES} AS resource_attributes,
    CASE WHEN event_id % 4 <> 0 THEN '{{"http.route":"/' || event_type || '","n":' || (event_id % 7) || '}}' END AS span_attributes,
    (CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 0 ELSE 1 END)::INTEGER AS status_code,
    CASE WHEN event_type = 'error' THEN 'failed' END AS status_message,
    CASE WHEN event_id % 5 = 0 THEN '[{{"attributes":{{"k":' || (event_id % 9) || '}},"dropped_attributes_count":0,"name":"evt.'
      || event_type || '","time_ns":"' || (us*1000) || '"}}]' END AS events,
    CASE WHEN event_id % 7 = 0 THEN '[{{"attributes":{{}},"dropped_attributes_count":0,"flags":1,"span_id":"' || {_SPAN}
      || '","trace_id":"' || {_TRACE} || '","trace_state":""}}]' END AS links,
    0::INTEGER AS dropped_attributes_count, 0::INTEGER AS dropped_events_count, 0::INTEGER AS dropped_links_count, 1::BIGINT AS flags
  FROM ev), spans AS (
  SELECT *, (end_ns-start_ns)/1e6 AS duration_ms, lag(span_id) OVER (PARTITION BY trace_id ORDER BY start_ns) AS parent_span_id FROM sp0)"""

LOGS = EV + f""", logs AS (
  SELECT us*1000 AS time_ns, CASE WHEN event_id % 3 <> 0 THEN us*1000 + 1000000 END AS observed_time_ns,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE 'TRACE' END AS severity_text,
    (CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9 WHEN 'view' THEN 5 ELSE 1 END)::INTEGER AS severity_number,
    svc AS service_name, 'app' AS scope_name, '1.0' AS scope_version, NULL::VARCHAR AS schema_url,
    '"' || event_type || ' by user ' || user_id || '"' AS body,
    CASE WHEN event_id % 2 = 0 THEN {_TRACE} END AS trace_id, CASE WHEN event_id % 2 = 0 THEN {_SPAN} END AS span_id,
    CASE WHEN event_id % 10 = 0 THEN 'evt.' || event_type END AS event_name, props AS log_attributes,
    {_RES} AS resource_attributes, 0::BIGINT AS flags
  FROM ev)"""

_HOURLY = f"""hourly AS (
  SELECT event_type, svc, event_id % 5 AS s, us - us % {HOUR_US} AS hour, count(*) AS n, sum(floor(value*100)::BIGINT)::BIGINT AS cents,
    max(value) AS mx, count(*) FILTER (value <= 5) AS b0, count(*) FILTER (value > 5 AND value <= 25) AS b1,
    count(*) FILTER (value > 25 AND value <= 100) AS b2, count(*) FILTER (value > 100) AS b3
  FROM ev GROUP BY ALL), running AS (
  SELECT event_type, svc, s, hour, sum(n) OVER w AS n, sum(cents) OVER w AS cents, max(mx) OVER w AS mx,
    sum(b0) OVER w AS b0, sum(b1) OVER w AS b1, sum(b2) OVER w AS b2, sum(b3) OVER w AS b3
  FROM hourly WINDOW w AS (PARTITION BY event_type, svc ORDER BY hour ROWS UNBOUNDED PRECEDING))"""


def _hist(metric: str, source: str, temporality: int) -> str:
    return f"""SELECT '{metric}' AS metric_name, 'histogram' AS metric_type, 'ms' AS metric_unit, 'Duration of an event' AS metric_description,
    {temporality}::INTEGER AS aggregation_temporality, NULL::BOOLEAN AS is_monotonic, svc AS service_name,
    '{{"service.instance.id":"i-' || (s % 3) || '","service.name":"' || svc || '"}}' AS resource_attributes,
    CASE WHEN event_type = 'error' THEN '{{"error.type":"E1","name":"error"}}' ELSE '{{"name":"' || event_type || '"}}' END AS series_attributes,
    hour*1000 AS start_ns, hour*1000 + {H} AS ts_ns, NULL::DOUBLE AS value_double, NULL::BIGINT AS value_int, n::BIGINT AS hist_count,
    cents/100.0::DOUBLE AS hist_sum, mx AS hist_max, '[5.0,25.0,100.0]' AS hist_bounds,
    '[' || b0 || ',' || b1 || ',' || b2 || ',' || b3 || ']' AS hist_bucket_counts, NULL::BIGINT AS exp_zero_count, NULL::INTEGER AS exp_scale,
    NULL::DOUBLE AS exp_zero_threshold, NULL::VARCHAR AS exp_buckets, NULL::BIGINT AS summary_count, NULL::DOUBLE AS summary_sum,
    NULL::VARCHAR AS summary_quantiles, 0::BIGINT AS flags FROM {source}"""


def _plain(metric: str, kind: str, where: str, **given: str) -> str:
    columns = dict(
        metric_unit="NULL", metric_description="NULL", aggregation_temporality="NULL", is_monotonic="NULL", service_name="svc",
        resource_attributes=_RES, series_attributes="NULL", start_ns="NULL", ts_ns="us*1000", value_double="NULL", value_int="NULL",
        hist_count="NULL", hist_sum="NULL", hist_max="NULL", hist_bounds="NULL", hist_bucket_counts="NULL", exp_zero_count="NULL",
        exp_scale="NULL", exp_zero_threshold="NULL", exp_buckets="NULL", summary_count="NULL", summary_sum="NULL",
        summary_quantiles="NULL", flags="0")
    columns.update(given)
    return (f"SELECT '{metric}' AS metric_name, '{kind}' AS metric_type, "
            + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM ev WHERE {where}")


PTS = EV + ", " + _HOURLY + ", points0 AS (" + " UNION ALL BY NAME ".join([
    _hist("app.duration", "running", 2), _hist("app.duration.delta", "hourly", 1),
    _plain("app.value", "gauge", "true", series_attributes="""'{"host":"h-' || (event_id % 2) || '"}'""",
           value_double="CASE WHEN event_id % 2 = 0 THEN value END", value_int="CASE WHEN event_id % 2 = 1 THEN floor(value)::BIGINT END"),
    _plain("app.purchases", "sum", "event_type = 'purchase'", metric_unit="'{purchase}'", aggregation_temporality="1",
           is_monotonic="true", value_int="1"),
    _plain("app.latency.exp", "exponential_histogram", "event_id % 50 = 0", aggregation_temporality="2", exp_zero_count="event_id % 3",
           exp_scale="1", exp_zero_threshold="0.0::DOUBLE", hist_count="event_id % 3 + event_id % 7 + event_id % 11 + 4",
           exp_buckets="""CASE WHEN event_id % 100 = 0 THEN '{"negative":null,"positive":{"bucket_counts":[' || (event_id % 7) || ',' || (event_id % 11)
             || ',4],"offset":' || (event_id % 4 - 2) || '}}' ELSE '{"negative":{"bucket_counts":[1,2],"offset":0},"positive":{"bucket_counts":['
             || (event_id % 7) || ',' || (event_id % 11) || ',1],"offset":' || (event_id % 4 - 2) || '}}' END"""),
    _plain("app.quantiles", "summary", "event_id % 50 = 1", summary_count="event_id % 9", summary_sum="((event_id % 9) * floor(value))::DOUBLE",
           summary_quantiles="""'[{"quantile":0.99,"value":' || floor(value*2)::BIGINT || '.5},{"quantile":0.5,"value":' || floor(value)::BIGINT
             || '.25},{"quantile":1.0,"value":"inf"}]'"""),
]) + """), pts AS (SELECT metric_name, metric_type, metric_unit, metric_description, aggregation_temporality::INTEGER AS aggregation_temporality,
  is_monotonic::BOOLEAN AS is_monotonic, service_name, NULL::VARCHAR AS scope_name, NULL::VARCHAR AS scope_version, NULL::VARCHAR AS schema_url,
  resource_attributes, series_attributes, NULL::VARCHAR AS metric_metadata, NULL::VARCHAR AS exemplars, start_ns::BIGINT AS start_ns, ts_ns,
  value_double::DOUBLE AS value_double, value_int::BIGINT AS value_int, hist_count::BIGINT AS hist_count, hist_sum::DOUBLE AS hist_sum,
  NULL::DOUBLE AS hist_min, hist_max::DOUBLE AS hist_max, hist_bounds, hist_bucket_counts, exp_zero_count::BIGINT AS exp_zero_count,
  exp_scale::INTEGER AS exp_scale, exp_zero_threshold::DOUBLE AS exp_zero_threshold, exp_buckets, summary_count::BIGINT AS summary_count,
  summary_sum::DOUBLE AS summary_sum, summary_quantiles, flags::BIGINT AS flags FROM points0)"""

ALL = SPANS + LOGS[len(EV):] + PTS[len(EV):]

ORACLE: dict[str, str] = {}


def add(key: str, ctes: str, body: str) -> None:
    ORACLE[key] = f"WITH {ctes}\n{body}"


def bucket(column: str, width_us: int = HALF_MIN_US) -> str:
    """Start of the time bucket as epoch microseconds."""
    return f"({column}//1000 - ({column}//1000) % {width_us})"


SUMMARY = """SELECT trace_id, min(start_ns) AS start_ns, max(end_ns)-min(start_ns) AS duration_ns, count(*) AS span_count,
  count(*) FILTER (status_code = 2) AS error_count, arg_min(span_name, (start_ns, span_id)) AS root_name,
  arg_min(service_name, (start_ns, span_id)) AS service, array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services"""


def summary(where: str = "true", having: str = "true", source: str = "spans") -> str:
    return f"{SUMMARY} FROM {source} WHERE {where} GROUP BY trace_id HAVING {having}"


ERRORS = "count(*) FILTER (status_code = 2) > 0"

# ------------------------------------------------------------ flattened envelopes

_SVC = "CASE WHEN event_id % 13 = 0 THEN 'unknown_service' ELSE svc END"
_FRES = """CASE WHEN event_id % 13 = 0 THEN '{"service.instance.id":"' || inst || '"}' ELSE """ + _RES + " END"
FLAT_SPANS = f"""SELECT {_TRACE} AS trace_id, {_SPAN} AS span_id, CASE WHEN event_id % 2 = 1 THEN lpad(lower(hex(event_id)),16,'0') END AS parent_span_id,
  CASE WHEN event_id % 11 = 0 THEN 'k=v' END AS trace_state, event_type AS span_name, (event_id % 6)::INTEGER AS span_kind, us*1000 AS start_ns,
  us*1000 + floor(value*1000)::BIGINT*1000 AS end_ns, (floor(value*1000)::BIGINT*1000)/1e6 AS duration_ms, {_SVC} AS service_name, 'app' AS scope_name,
  '1.0' AS scope_version, 'http://schema/r' AS schema_url, {_FRES} AS resource_attributes,
  CASE WHEN event_id % 4 <> 0 THEN '{{"http.route":"/' || event_type || '","n":' || (event_id % 7)
    || CASE WHEN event_id % 10 = 1 THEN ',"tags":[1,"b",{{"a":2.5,"z":true}}]' ELSE '' END || '}}' END AS span_attributes,
  (CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 0 ELSE 1 END)::INTEGER AS status_code, CASE WHEN event_type = 'error' THEN 'failed' END AS status_message,
  CASE WHEN event_id % 5 = 0 THEN '[{{"attributes":{{"k":' || (event_id % 9) || '}},"dropped_attributes_count":0,"name":"evt.' || event_type
    || '","time_ns":"' || (us*1000) || '"}}]' END AS events, NULL::VARCHAR AS links, 0::INTEGER AS dropped_attributes_count,
  0::INTEGER AS dropped_events_count, 0::INTEGER AS dropped_links_count, 1::BIGINT AS flags FROM ev"""
add("s1_flatten_traces", EV, FLAT_SPANS)
add("t1_stream_ingest", EV, FLAT_SPANS)
add("s2_flatten_logs", EV, f"""SELECT us*1000 AS time_ns, CASE WHEN event_id % 3 <> 0 THEN us*1000+1000000 END AS observed_time_ns,
  CASE WHEN event_type = 'error' THEN 'ERROR' END AS severity_text, (CASE WHEN event_type = 'error' THEN 17 ELSE 9 END)::INTEGER AS severity_number,
  {_SVC} AS service_name, 'app' AS scope_name, '1.0' AS scope_version, 'http://schema/r' AS schema_url,
  '"' || event_type || ' by \\"user\\" ' || user_id || '"' AS body, CASE WHEN event_id % 2 = 0 THEN {_TRACE} END AS trace_id,
  CASE WHEN event_id % 2 = 0 THEN {_SPAN} END AS span_id, NULL::VARCHAR AS event_name,
  '{{"ok":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"v":' || (event_id % 8) || '.5}}' AS log_attributes,
  {_FRES} AS resource_attributes, 0::BIGINT AS flags FROM ev""")
_KIND = "CASE event_id % 6 WHEN 0 THEN 'gauge' WHEN 1 THEN 'sum' WHEN 2 THEN 'histogram' WHEN 3 THEN 'exponential_histogram' WHEN 4 THEN 'summary' END"
add("s3_flatten_metrics", EV, f"""SELECT 'm.' || (event_id % 6) AS metric_name, {_KIND} AS metric_type, {_SVC} AS service_name, count(*) AS points,
  max(us*1000) AS last_ns FROM ev WHERE event_id % 6 <> 5 GROUP BY 1, 2, 3""")
_POINT = f"""'m.' || (event_id % 6) AS metric_name, {_SVC} AS service_name, '{{"host":"h-' || (event_id % 2) || '"}}' AS series_attributes, us*1000 AS ts_ns"""
add("s3a_number_points", EV, f"""SELECT {_POINT}, CASE WHEN event_id % 6 = 1 THEN 2 END::INTEGER AS aggregation_temporality,
  CASE WHEN event_id % 6 = 1 THEN true END AS is_monotonic, CASE WHEN event_id % 3 <> 0 THEN us*1000 - 1000000000 END AS start_ns,
  CASE WHEN event_id % 2 = 0 THEN (event_id % 10) + 0.25::DOUBLE END AS value_double, CASE WHEN event_id % 2 = 1 THEN event_id % 10 END AS value_int
  FROM ev WHERE event_id % 6 IN (0, 1)""")
add("s3b_histogram_points", EV, f"""SELECT {_POINT}, event_id % 7 + 1 AS hist_count, (event_id % 5) + 0.5::DOUBLE AS hist_sum, 0.5::DOUBLE AS hist_min,
  9.0::DOUBLE AS hist_max, '[5.0,"inf"]' AS hist_bounds, '[' || (event_id % 7) || ',1,0]' AS hist_bucket_counts,
  '[{{"filtered_attributes":{{}},"span_id":"' || {_SPAN} || '","time_ns":"' || (us*1000) || '","trace_id":"","value":3}}]' AS exemplars
  FROM ev WHERE event_id % 6 = 2""")
add("s3c_exponential_points", EV, f"""SELECT {_POINT}, 1::INTEGER AS aggregation_temporality, event_id % 7 + 2 AS hist_count, event_id % 3 AS exp_zero_count,
  1::INTEGER AS exp_scale, 0.0::DOUBLE AS exp_zero_threshold,
  '{{"negative":null,"positive":{{"bucket_counts":[' || (event_id % 7) || ',2],"offset":-1}}}}' AS exp_buckets FROM ev WHERE event_id % 6 = 3""")
add("s3d_summary_points", EV, f"""SELECT {_POINT}, event_id % 9 AS summary_count, (event_id % 4) + 0.5::DOUBLE AS summary_sum,
  '[{{"quantile":0.5,"value":' || (event_id % 6) || '.25}},{{"quantile":1.0,"value":"inf"}}]' AS summary_quantiles, NULL::VARCHAR AS exemplars,
  0::BIGINT AS flags FROM ev WHERE event_id % 6 = 4""")

ORACLE["t1_stream_logs"], ORACLE["t1_stream_metrics"] = ORACLE["s2_flatten_logs"], ORACLE["s3_flatten_metrics"]

# ------------------------------------------------------------ store and scans

add("s4_append", SPANS, """SELECT strftime(make_timestamp(start_ns//1000), '%Y-%m-%d') AS event_date, count(*) AS n, sum(end_ns)::VARCHAR AS end_sum
  FROM spans GROUP BY 1""")
for _key in ("s4_append_spans", "s4_compacted"):
    add(_key, SPANS, "SELECT * REPLACE (NULL::VARCHAR AS parent_span_id) FROM spans")
add("s4_append_logs", LOGS, "SELECT * FROM logs")
add("s4_append_points", PTS, "SELECT * FROM pts")
add("s5_reset", ALL, """SELECT * FROM (SELECT 'spans' AS table_name, 'before' AS state, count(*) AS n FROM spans UNION ALL SELECT 'log_records', 'before', count(*) FROM logs
  UNION ALL SELECT 'metric_points', 'before', count(*) FROM pts UNION ALL SELECT t, 'after', 0 FROM (VALUES ('spans'), ('log_records'), ('metric_points')) v(t))""")
add("s6_scan_spans", SPANS, """SELECT trace_id, span_id, parent_span_id, span_name, span_kind, start_ns, end_ns, duration_ms, service_name, resource_attributes,
  span_attributes, status_code, status_message, events, links, flags FROM spans""")
add("s6_scan_logs", LOGS, "SELECT * FROM logs")
add("s6_scan_points", PTS, "SELECT * FROM pts")
add("s8_generate_series", SPANS, f"""SELECT hour, count(start_ns) AS n FROM (SELECT unnest(generate_series(min(start_ns - start_ns % {H}), max(start_ns - start_ns % {H}),
  {H})) AS hour FROM spans) a LEFT JOIN spans s ON s.start_ns - s.start_ns % {H} = a.hour GROUP BY hour""")

_COUNT_OF = {"spans": "spans", "log_records": "logs", "metric_points": "pts"}
_SQL_NAMES = {"STRING": "VARCHAR", "INT": "INTEGER"}
_COLUMNS = [(t, i, *line.rstrip(",").split()[:2]) for t, ddl in DDL.items() for i, line in enumerate(ddl.strip().splitlines(), 1)]
_schema_rows = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {_COUNT_OF[t]}) AS row_count, {i}::INTEGER AS ordinal, '{c}' AS column_name, "
    f"'{_SQL_NAMES.get(kind, kind)}' AS data_type" for t, i, c, kind in _COLUMNS)
for _key in ("s9_schema_listing", "q8_schema"):
    add(_key, ALL, _schema_rows)
add("s10_table_stats", ALL, """SELECT 'spans' AS table_name, count(*) AS estimated_size, 23::INTEGER AS column_count, true AS has_bytes FROM spans
  UNION ALL SELECT 'log_records', count(*), 15, true FROM logs UNION ALL SELECT 'metric_points', count(*), 32, true FROM pts""")

# ------------------------------------------------------------ scalar functions and filters

add("f23_epoch_ms", SPANS, """SELECT span_id, start_ns/1e6 AS ns_ms, (start_ns//1000)/1e3 AS us_ms, (start_ns//1000000)::DOUBLE AS ms_ms,
  (start_ns//1000000000)*1e3 AS s_ms, NULL::DOUBLE AS small_ms, (start_ns//1000000)::DOUBLE AS iso_ms FROM spans""")
add("f25_enum_labels", ALL, """SELECT CASE span_kind WHEN 0 THEN 'unspecified' WHEN 1 THEN 'internal' WHEN 2 THEN 'server' WHEN 3 THEN 'client' WHEN 4 THEN 'producer'
  ELSE 'consumer' END AS kind, CASE status_code WHEN 2 THEN 'ERROR' WHEN 1 THEN 'OK' ELSE 'UNSET' END AS label, status_code = 2 AS is_error, count(*) AS n
  FROM spans GROUP BY 1, 2, 3 UNION ALL SELECT 'severity', CASE severity_text WHEN 'ERROR' THEN 'destructive' WHEN 'WARN' THEN 'default' WHEN 'INFO' THEN 'secondary'
  ELSE 'outline' END, false, count(*) FROM logs GROUP BY severity_text""")
add("p1_trace_filters", SPANS, summary(
    f"service_name = 'svc-1' AND (span_name ILIKE '%R%' OR trace_id ILIKE '%R%') AND start_ns >= {MID0} AND end_ns <= {MID1} AND end_ns - start_ns >= 20500000"))
add("p2_log_filters", LOGS, f"""SELECT time_ns, body, severity_text FROM logs WHERE service_name = 'svc-2' AND severity_number >= 13 AND time_ns BETWEEN {MID0} AND {MID1}
  AND (body ILIKE '%USER 1%' OR log_attributes ILIKE '%USER 1%' OR severity_text ILIKE '%USER 1%' OR event_name ILIKE '%USER 1%')""")
add("p3_metric_filters", PTS, """SELECT metric_name, count(*) AS n FROM pts WHERE service_name = 'svc-3' AND (metric_name ILIKE '%DURATION%'
  OR metric_description ILIKE '%DURATION%') GROUP BY 1""")
add("p4_point_filters", PTS, f"""SELECT ts_ns, value_double, value_int FROM pts WHERE metric_name = 'app.value' AND service_name = 'svc-3'
  AND ts_ns BETWEEN {MID0} AND {MID1}""")
add("p5_optional_parameters", PTS, """SELECT ts_ns, service_name, hist_count FROM pts WHERE metric_name = 'app.duration' AND (NULL IS NULL OR service_name = NULL)
  AND json_extract_string(series_attributes, '$."name"') = 'error' AND json_extract_string(resource_attributes, '$."service.instance.id"') = 'i-1'""")
add("p6_inclusive_range", SPANS, f"SELECT count(*) AS n, min(start_ns) AS lo, max(start_ns) AS hi FROM spans WHERE start_ns BETWEEN {MID0} AND {MID1}")
add("p7_error_tests", ALL, """SELECT * FROM (SELECT service_name, count(*) FILTER (status_code = 2) AS error_spans, count(*) FILTER (status_code >= 2) AS error_or_above
  FROM spans GROUP BY 1) JOIN (SELECT service_name, count(*) FILTER (severity_number >= 17) AS error_logs FROM logs GROUP BY 1) USING (service_name)""")
add("p8_guards", PTS, "SELECT metric_name, count(*) AS n FROM pts WHERE hist_count > 0 AND series_attributes IS NOT NULL GROUP BY 1")
add("p9_time_presets", SPANS, f"SELECT span_id, start_ns FROM spans WHERE start_ns >= (SELECT max(start_ns) FROM spans) - {7 * 24 * H}")

# ------------------------------------------------------------ aggregations

add("a1_trace_summary", SPANS, summary())
add("t4_stream_traces", SPANS, summary())
add("t4_stream_sessions", SPANS, summary())
add("o1_newest_traces", SPANS, summary())
add("a2_error_traces", SPANS, summary(having=ERRORS))
add("a3_trace_total", SPANS, f"SELECT count(*) AS total FROM ({summary(having=ERRORS)})")
METRIC_SUMMARY = """SELECT metric_name, metric_type, metric_unit, metric_description, count(*) AS point_count, count(DISTINCT service_name) AS service_count,
  array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns,
  arg_max(value_double, ts_ns) AS last_value FROM pts"""
add("a4_metric_summary", PTS, METRIC_SUMMARY + " GROUP BY ALL")
for _key in ("a5_service_rollup", "q6_services"):
    add(_key, ALL, """SELECT service_name, min(a) AS first_ns, max(b) AS last_ns, count(*) FILTER (k = 's') AS span_count, count(*) FILTER (k = 'l') AS log_count,
  count(*) FILTER (k = 'p') AS point_count FROM (SELECT service_name, start_ns AS a, end_ns AS b, 's' AS k FROM spans
  UNION ALL SELECT service_name, time_ns, time_ns, 'l' FROM logs UNION ALL SELECT service_name, ts_ns, ts_ns, 'p' FROM pts) GROUP BY 1""")
for _key in ("a6_global_stats", "q7_stats"):
    add(_key, ALL, """SELECT count(*) FILTER (k = 's') AS spans, count(DISTINCT t) AS traces, count(*) FILTER (k = 'l') AS logs,
  count(*) FILTER (k = 'p') AS metric_points, count(DISTINCT m) AS metrics, count(DISTINCT service_name) AS services, min(a) AS earliest_ns, max(b) AS latest_ns
  FROM (SELECT service_name, start_ns AS a, end_ns AS b, 's' AS k, trace_id AS t, NULL AS m FROM spans
  UNION ALL SELECT service_name, time_ns, time_ns, 'l', NULL, NULL FROM logs UNION ALL SELECT service_name, ts_ns, ts_ns, 'p', NULL, metric_name FROM pts)""")
add("a7_filtered_aggregate", LOGS, """SELECT service_name, count(*) FILTER (severity_number >= 17) AS errors, max(time_ns) FILTER (trace_id IS NOT NULL) AS last_traced_ns
  FROM logs GROUP BY 1""")
add("a8_arg_min_max", SPANS, """SELECT service_name, arg_min(span_name, (start_ns, span_id)) AS first_name, arg_max(span_name, (start_ns, span_id)) AS last_name
  FROM spans GROUP BY 1""")
add("a9_distinct_list", SPANS, "SELECT trace_id, array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services FROM spans GROUP BY 1")
add("a10_count_distinct", SPANS, "SELECT span_name, count(DISTINCT trace_id) AS traces FROM spans GROUP BY 1")

OBSERVED = "SELECT * FROM pts WHERE metric_name = 'app.duration' AND hist_count > 0"
TIE = "ts_ns, service_name, resource_attributes"
TIE_DESC = "ts_ns DESC, service_name DESC, resource_attributes DESC"


def numbered(keys: str, order: str, where: str = "true") -> str:
    """Adds ``numbered``: the observed points with their place in the series, and ``pairs``, each point with the one before it."""
    same = " AND ".join(f"p.{k.strip()} IS NOT DISTINCT FROM q.{k.strip()}" for k in keys.split(","))
    return f"""{PTS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS place FROM ({OBSERVED} AND {where})),
  pairs AS (SELECT q.*, p.place AS place_before, p.ts_ns AS ts_before, p.hist_count AS count_before, p.hist_sum AS sum_before
  FROM numbered q LEFT JOIN numbered p ON {same} AND p.place + 1 = q.place)"""


def increases(where: str = "true") -> str:
    """Adds ``steps``: the observed points with the growth of count (``up``) and sum (``up_sum``), 0 without a smaller point before."""
    grown = lambda c, before: f"CASE WHEN {c} > {before} THEN {c} - {before} ELSE 0 END"
    return numbered("series_attributes", f"{TIE}, hist_count", where) + f""", steps AS (
  SELECT *, {grown('hist_count', 'count_before')} AS up, {grown('hist_sum', 'sum_before')} AS up_sum FROM pairs)"""


NAME = """json_extract_string(series_attributes, '$."name"')"""
ERR = """json_extract_string(series_attributes, '$."error.type"')"""
add("a11_grouping_sets", increases(), f"""SELECT CASE WHEN grouping(name) = 1 THEN 'Total' ELSE name END AS name, sum(up)::BIGINT AS n
  FROM (SELECT {NAME} AS name, up FROM steps) GROUP BY GROUPING SETS ((name), ())""")
add("a12_quantile_disc", SPANS, f"""SELECT {bucket('start_ns', HOUR_US)} AS ts, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95,
  quantile_disc(duration_ms, 0.99) AS p99 FROM spans GROUP BY 1""")
add("a13_quantile_cont", SPANS, """SELECT span_name, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95 FROM spans GROUP BY 1""")
add("a14_conditional_share", SPANS, "SELECT service_name, round(100.0*sum(CASE WHEN status_code >= 2 THEN 1 ELSE 0 END)/count(*), 2) AS err_pct FROM spans GROUP BY 1")
add("a15_basic_aggregates", SPANS, """SELECT service_name, span_kind, count(*) AS n, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
  sum(end_ns-start_ns)::BIGINT AS sum_ns, (sum(end_ns-start_ns)//count(*))::BIGINT AS avg_ns FROM spans GROUP BY 1, 2""")
add("a16_histogram_mean", PTS, "SELECT service_name, series_attributes, ts_ns, round(hist_sum/hist_count, 3) AS mean FROM pts WHERE metric_name = 'app.duration'")
add("a17_distinct_attribute", SPANS, """SELECT DISTINCT json_extract_string(span_attributes, '$."http.route"') AS v FROM spans WHERE span_attributes IS NOT NULL""")
add("a18_profile", SPANS, " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, count(*) AS count, count(*) - count({c}) AS null_count FROM spans"
    for t, _, c, _ in _COLUMNS if t == "spans" and c not in ("duration_ms", "parent_span_id"))
    + " UNION ALL SELECT 'parent_span_id', NULL, NULL, count(*), count(*) FROM spans")



def _profile(c: str, kind: str) -> str:
    """One column's row: figures with six digits."""
    number = kind in ("INT", "BIGINT", "DOUBLE")
    six = lambda x: f"CASE WHEN {x} <> 0 THEN round({x} / pow(10.0, floor(log10(abs({x})))), 6) ELSE {x} END"
    figures = [six(f"({f})::DOUBLE") for f in (f"avg({c})", f"stddev_samp({c})", *[f"quantile_disc({c}, {p})" for p in (0.25, 0.5, 0.75)])]
    figures = figures if number else ["NULL::DOUBLE"] * 5
    names = ("avg", "std", "q25", "q50", "q75")
    return (f"SELECT '{c}' AS column_name, true AS unique_near, {', '.join(f'{f} AS {n}' for f, n in zip(figures, names))}, count(*) AS count, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percentage FROM plain")


add("a18_summarize", SPANS + ", plain AS (SELECT * REPLACE (NULL::VARCHAR AS parent_span_id) FROM spans)",
    " UNION ALL ".join(_profile(c, kind.split()[0]) for t, _, c, kind in _COLUMNS if t == "spans"))
_KIND_OF = lambda c: f"""CASE WHEN {c} IS NULL THEN NULL WHEN NOT json_valid({c}) THEN 'string' ELSE CASE json_type({c}) WHEN 'OBJECT' THEN 'object'
  WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END"""
add("f11_json_values", LOGS + """, texts AS (SELECT time_ns, span_id, body, log_attributes, substr(log_attributes, 1, 5) AS broken,
  '{"a.b":{"c":[1,' || log_attributes || ']}}' AS nested FROM logs)""", f"""SELECT time_ns, span_id, {", ".join(f"{_KIND_OF(c)} AS {c}_kind"
  for c in ("body", "log_attributes", "broken", "nested"))}, body ->> '$' AS body_text, log_attributes ->> '$.k' AS k, broken AS broken_text,
  nested ->> '$."a.b".c[1].k' AS inner_k FROM texts""")

# ------------------------------------------------------------ windows, joins, sets, sorts

INCREASE_ROWS = "SELECT service_name, series_attributes, ts_ns, hist_count, up AS inc_hist_count FROM steps"
add("w1_counter_increase", increases(), INCREASE_ROWS)
add("t3_stream_increase", increases(), INCREASE_ROWS)
add("w2_latest_per_group", PTS, f"""SELECT series_attributes, service_name, ts_ns, hist_count FROM (SELECT *, row_number() OVER (PARTITION BY series_attributes
  ORDER BY {TIE_DESC}) AS rn FROM ({OBSERVED})) WHERE rn = 1""")


def snapshots(where: str = "true", width: int = HALF_MIN_US, keys: str = "", finite: bool = True) -> str:
    """Adds ``newest`` (bounds and counts of the newest point per bucket and key), its ``cells`` and, per bound,
    the count ``seen`` up to it (``reach``)."""
    by = f", {keys}" if keys else ""
    same = " AND ".join(f"a.{k} = b.{k}" for k in ["ts", *filter(None, keys.split(", "))])
    of_a = ", ".join(f"a.{k}" for k in ["ts", *filter(None, keys.split(", "))])
    kept = "isfinite(x)" if finite else "true"
    return f"""{PTS}, newest AS (SELECT ts {by}, list_filter(p.b::DOUBLE[], lambda x: {kept}) AS edges, p.c::DOUBLE[] AS counts FROM (
  SELECT {bucket('ts_ns', width)} AS ts {by}, arg_max({{'b': hist_bounds, 'c': hist_bucket_counts}}, ({TIE}, series_attributes)) AS p
  FROM ({OBSERVED}) WHERE {where} GROUP BY ALL)), cells AS (
  SELECT ts {by}, unnest(edges || ['inf'::DOUBLE]) AS edge, unnest(counts) AS n FROM newest), reach AS (
  SELECT {of_a}, a.edge, sum(b.n) AS seen FROM cells a JOIN cells b ON {same} AND b.edge <= a.edge GROUP BY ALL), shares AS (
  SELECT *, seen / max(seen) OVER (PARTITION BY ts {by}) AS share, edge < 'inf'::DOUBLE AS closed FROM reach)"""


def percentiles(keys: str = "") -> str:
    by = f", {keys}" if keys else ""
    one = lambda q: f"round(coalesce(min(edge) FILTER (closed AND share >= {q}), max(edge) FILTER (closed)), 3)"
    return f"SELECT ts {by}, {one(0.5)} AS p50, {one(0.95)} AS p95, {one(0.99)} AS p99 FROM shares GROUP BY ALL"


def heat(where: str = "true") -> tuple[str, str]:
    return snapshots(where), """SELECT ts, CASE i WHEN 1 THEN 0.0::DOUBLE ELSE edges[i - 1] END AS y, counts[i] AS weight
  FROM (SELECT *, unnest(range(1, len(counts) + 1)) AS i FROM newest)"""


P95_OPEN = "SELECT ts, CASE WHEN bool_or(closed AND share >= 0.95) THEN round(min(edge) FILTER (share >= 0.95), 3) END AS p95_s FROM shares GROUP BY ts"
add("w3_running_sum", snapshots(width=HOUR_US), "SELECT ts, CASE WHEN closed THEN edge ELSE -1 END AS bound, seen AS cum_n FROM shares")
add("j1_inner_join", snapshots(width=HOUR_US), """SELECT ts, (i - 1)::INTEGER AS i, counts[i] AS c, list_sum(counts) AS n FROM (
  SELECT *, unnest(range(1, len(counts) + 1)) AS i FROM newest)""")
add("j2_left_join", PTS, f"""SELECT name, a.n AS n, m.mx AS mx FROM (SELECT name, count(*) AS n FROM (SELECT CASE WHEN service_name <> 'svc-4' THEN {NAME} END AS name FROM ({OBSERVED})) GROUP BY 1) a
  LEFT JOIN (SELECT name, hist_max AS mx FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {TIE_DESC}, series_attributes DESC, hist_max DESC) AS rn
  FROM (SELECT *, CASE WHEN service_name <> 'svc-4' THEN {NAME} END AS name FROM ({OBSERVED}))) WHERE rn = 1) m USING (name)""")
add("j3_scalar_subquery", PTS, f"""SELECT service_name, max(hist_max) AS mx, (SELECT max(hist_max) FROM pts WHERE metric_name = 'app.duration') AS all_mx
  FROM pts WHERE metric_name = 'app.duration' GROUP BY 1""")
add("j4_logs_to_spans", ALL, """SELECT l.time_ns, l.body, l.trace_id, l.span_id, s.span_name, s.service_name AS span_service, s.status_code
  FROM logs l LEFT JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id""")
add("j5_parent_child", SPANS, """SELECT c.trace_id, c.span_id, c.parent_span_id, p.span_name AS parent_name, p.service_name AS parent_service, p.span_id IS NULL AS is_root
  FROM spans c LEFT JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id""")
add("u1_union_all", ALL, "SELECT 'span' AS signal, service_name, start_ns AS t FROM spans UNION ALL SELECT 'log', service_name, time_ns FROM logs")
add("u2_service_set", ALL, "SELECT service_name FROM spans UNION SELECT service_name FROM logs UNION SELECT service_name FROM pts")
add("o2_newest_logs", LOGS, "SELECT time_ns, service_name, body FROM logs ORDER BY time_ns DESC")
add("o3_null_aware_sort", PTS, "SELECT metric_unit, count(*) AS n FROM pts GROUP BY 1 ORDER BY metric_unit IS NULL, metric_unit")
add("o4_paging", SPANS, f"SELECT *, (SELECT count(DISTINCT trace_id) FROM spans) AS total FROM ({summary()}) ORDER BY start_ns DESC, trace_id LIMIT 50 OFFSET 25")
add("o5_top_k", SPANS, "SELECT span_id, start_ns, service_name FROM spans ORDER BY start_ns DESC, span_id LIMIT 10")
add("g1_parallel_unnest", PTS, """SELECT service_name, series_attributes, ts_ns, unnest(hist_bounds::DOUBLE[]) AS bound, unnest(hist_bucket_counts::DOUBLE[]) AS c
  FROM pts WHERE metric_name = 'app.duration'""")
add("g2_cte_chain", SPANS, """, slow AS (SELECT trace_id, duration_ms FROM spans WHERE duration_ms > 50), per_trace AS (SELECT trace_id, count(*) AS n, max(duration_ms) AS longest
  FROM slow GROUP BY 1) SELECT n, count(*) AS traces, max(longest) AS longest FROM per_trace GROUP BY 1""")

# ------------------------------------------------------------ composite queries

_Q = "(span_name ILIKE '%err%' OR trace_id ILIKE '%err%')"
add("q1_traces_list", SPANS, f"""SELECT *, (SELECT count(*) FROM ({summary(_Q, ERRORS)})) AS total FROM ({summary(_Q, ERRORS)})
  ORDER BY start_ns DESC, trace_id LIMIT 200""")
add("q1b_whole_traces", SPANS, summary(
    "trace_id IN (SELECT trace_id FROM spans WHERE service_name = 'svc-1' AND (span_name ILIKE '%error%' OR trace_id ILIKE '%error%'))", ERRORS))
_NEWEST = "trace_id = (SELECT arg_max(trace_id, (start_ns, trace_id)) FROM spans)"
add("q2_trace_detail", SPANS, f"""SELECT trace_id, span_id, parent_span_id, span_name, start_ns, end_ns, span_attributes, events FROM spans WHERE {_NEWEST}
  ORDER BY start_ns, span_id""")
add("q2_trace_detail_summary", SPANS, summary(_NEWEST))
add("q2_trace_detail_stored", SPANS, f"SELECT trace_id, span_id, span_name, start_ns, end_ns, span_attributes, events FROM spans WHERE {_NEWEST}")
add("j4_logs_of_trace_stored", LOGS, """SELECT time_ns, trace_id, span_id, body, severity_text FROM logs
  WHERE trace_id = (SELECT arg_max(trace_id, (time_ns, trace_id)) FROM logs WHERE trace_id IS NOT NULL)""")
add("p2_search_stored", LOGS, """SELECT time_ns, span_id, body FROM logs WHERE severity_number >= 13 AND (body ILIKE '%SE by user 1%'
  OR log_attributes ILIKE '%SE by user 1%' OR severity_text ILIKE '%SE by user 1%' OR event_name ILIKE '%SE by user 1%')""")
add("q7_stats_stored", ALL, """SELECT (SELECT count(*) FROM spans) AS spans, (SELECT count(*) FROM logs) AS logs, (SELECT count(*) FROM pts) AS metric_points,
  least((SELECT min(start_ns) FROM spans), (SELECT min(time_ns) FROM logs), (SELECT min(ts_ns) FROM pts)) AS earliest_ns,
  greatest((SELECT max(end_ns) FROM spans), (SELECT max(time_ns) FROM logs), (SELECT max(ts_ns) FROM pts)) AS latest_ns,
  true AS traces_near, true AS metrics_near, true AS services_near""")
_LOGQ = "severity_number >= 17 AND (body ILIKE '%user%' OR log_attributes ILIKE '%user%' OR severity_text ILIKE '%user%' OR event_name ILIKE '%user%')"
add("q3_logs_list", LOGS, f"""SELECT time_ns, service_name, severity_text, body, trace_id, (SELECT count(*) FROM logs WHERE {_LOGQ}) AS total FROM logs WHERE {_LOGQ}
  ORDER BY time_ns DESC, service_name, body LIMIT 300""")
add("q4_metrics_list", PTS, METRIC_SUMMARY + """ WHERE service_name = 'svc-1' AND (metric_name ILIKE '%app%' OR metric_description ILIKE '%app%')
  GROUP BY metric_name, metric_type, metric_unit, metric_description ORDER BY metric_name LIMIT 100""")
add("q5_metric_detail", PTS, """SELECT service_name, series_attributes, resource_attributes, ts_ns, value_double, value_int FROM pts
  WHERE metric_name = 'app.value' AND service_name = 'svc-2' ORDER BY ts_ns, series_attributes, resource_attributes LIMIT 20000""")
add("q5_metric_metadata", PTS, "SELECT DISTINCT metric_name, metric_type, metric_unit, metric_description FROM pts WHERE metric_name = 'app.duration'")
add("q9_console", SPANS, "SELECT service_name, count(*) AS n, max(end_ns) AS last_ns FROM spans GROUP BY 1")
add("q10_attribute_options", PTS, """SELECT DISTINCT json_extract_string(resource_attributes, '$."service.instance.id"') AS v FROM pts""")
add("q10_input_options", PTS, f"SELECT DISTINCT {NAME} AS v FROM pts WHERE series_attributes IS NOT NULL AND {NAME} IS NOT NULL")

ROUTE = """json_extract_string(span_attributes, '$."http.route"')"""
_RATE = "round(count(*)/30.0, 2) AS rps"
_SHARE = "round(100.0*sum(CASE WHEN status_code >= 2 THEN 1 ELSE 0 END)/count(*), 2) AS err_pct"
_P95 = "round(quantile_disc(duration_ms, 0.95), 2) AS p95_ms"


def span_series(what: str, where: str = "true") -> str:
    return f"SELECT {bucket('start_ns')} AS ts, {what} FROM spans WHERE {where} GROUP BY 1"


def routes(where: str = "true") -> str:
    return f"SELECT coalesce({ROUTE}, span_name) AS route, count(*) AS requests FROM spans WHERE {where} GROUP BY 1"


add("q11_dashboard_run", SPANS, span_series(f"{_RATE}, {_SHARE}, {_P95}", f"service_name = 'svc-1' AND {ROUTE} = '/view'"))
add("q11_custom_panel", SPANS, "SELECT service_name, count(*) AS n FROM spans WHERE span_name = 'view' GROUP BY 1")

# ------------------------------------------------------------ histograms, counters, rates


def rate(where: str = "true") -> tuple[str, str]:
    return increases(where), f"SELECT {bucket('ts_ns')} AS ts, round(sum(up)::DOUBLE/30, 2) AS rps FROM steps GROUP BY 1"


def total(where: str = "true") -> tuple[str, str]:
    # A series' counts as one sorted list: what each entry has more than the one before it.
    return PTS, f"""SELECT sum(list_sum(list_transform(range(2, len(l) + 1), lambda i: greatest(l[i] - l[i - 1], 0))))::BIGINT AS requests
  FROM (SELECT list(hist_count ORDER BY {TIE}, hist_count) AS l FROM ({OBSERVED} AND {where}) GROUP BY series_attributes)"""


def by_endpoint(where: str = "true") -> tuple[str, str]:
    return increases(where), f"SELECT {NAME} AS endpoint, sum(up)::BIGINT AS requests FROM steps GROUP BY 1 HAVING endpoint IS NOT NULL"


def by_error(where: str = "true") -> tuple[str, str]:
    return increases(where), f"SELECT ifnull({ERR}, '(ok)') AS error_type, sum(up)::BIGINT AS requests FROM steps GROUP BY 1"


def endpoints(where: str = "true") -> tuple[str, str]:
    ctes = increases(where) + f""", per AS (SELECT ifnull({NAME}, '(no name)') AS who, sum(up)::BIGINT AS n, sum(if({ERR} IS NULL, 0, up))::BIGINT AS bad, sum(up_sum) AS secs,
  arg_max(hist_max, ({TIE}, series_attributes, hist_max)) AS top, min(ts_ns) AS lo, max(ts_ns) AS hi FROM steps GROUP BY 1), whole AS (
  SELECT 'Total' AS who, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, sum(secs) AS secs, max(top) AS top, min(lo) AS lo, max(hi) AS hi FROM per)"""
    return ctes, """SELECT r.who AS "Name", r.n AS "Count", concat(r.bad, ' (', round(r.bad*100.0/r.n, 1), '%)') AS "Failures",
  round(r.secs/r.n*1000, 1) AS "Avg (ms)", round(r.top*1000, 1) AS "Max (ms)", round(r.n/((w.hi - w.lo)/1e9), 2) AS "Rate/s"
  FROM (SELECT * FROM per UNION ALL SELECT * FROM whole) r, whole w"""


def gauge(value: str = "value", where: str = "true") -> tuple[str, str]:
    return PTS, f"SELECT ts_ns//1000 AS ts, coalesce(value_double, value_int) AS {value} FROM pts WHERE metric_name = 'app.value' AND {where}"


def gauge_latest(value: str = "value", where: str = "true") -> tuple[str, str]:
    return PTS, f"""SELECT coalesce(value_double, value_int) AS {value} FROM pts WHERE metric_name = 'app.value' AND {where}
  ORDER BY ts_ns DESC, service_name, series_attributes LIMIT 1"""


add("h1_histogram_percentiles", snapshots(), percentiles())
add("h1_per_series", snapshots(width=HOUR_US, keys="service_name, series_attributes"), percentiles("service_name, series_attributes"))
for _key in ("h1b_percentile_open", "e10_latency_p95"):
    add(_key, snapshots(finite=False), P95_OPEN)
add("h2_latency_heatmap", *heat())
for _key in ("h3_counter_rate", "e11_requests_per_second"):
    add(_key, *rate())
add("h4_increase_total", *total())
add("h5_increase_by_endpoint", *by_endpoint())
add("h5_increase_by_error", *by_error())
add("h6_endpoint_stats", *endpoints())
add("h7_rate_delta", PTS, f"""SELECT {bucket('ts_ns', HOUR_US)} AS ts, round(sum((2*hist_count::HUGEINT*10000000000000000000 + ts_ns-start_ns)//(2*(ts_ns-start_ns)))/1e10, 4) AS rps, sum(hist_count)::BIGINT AS requests
  FROM pts WHERE metric_name = 'app.duration.delta' AND hist_count > 0 GROUP BY 1""")
add("h7_rate_cumulative", numbered("series_attributes, service_name, resource_attributes", "ts_ns"), f"""SELECT {bucket('ts_ns', HOUR_US)} AS ts,
  round(sum((2*n::HUGEINT*10000000000000000000 + span)//(2*span))/1e10, 4) AS rps, sum(n)::BIGINT AS requests FROM (
  SELECT ts_ns, greatest(hist_count - count_before, 0) AS n, ts_ns - ts_before AS span FROM pairs WHERE place > 1) GROUP BY 1""")
add("h8_gauge_series", *gauge())
add("e9_users_over_time", *gauge("users"))
add("h8_gauge_latest", *gauge_latest())
add("h9_span_rate", SPANS, span_series(_RATE))
add("h10_span_error_share", SPANS, span_series(_SHARE))
add("t2_stream_red", SPANS, span_series(f"{_RATE}, {_SHARE}"))
add("h11_span_p95", SPANS, span_series(_P95))
add("h12_top_routes", SPANS, routes())

# ------------------------------------------------------------ panels

_S1 = "service_name = 'svc-1'"
add("d_loadtest_stats", *endpoints(_S1))
add("d_loadtest_users_now", *gauge_latest("users", _S1))
add("d_loadtest_requests_total", *total(_S1))
add("d_loadtest_users", *gauge("users", _S1))
add("d_loadtest_rps", *rate(_S1))
add("d_loadtest_latency", snapshots(_S1), percentiles())
add("d_loadtest_heatmap", *heat(_S1))
add("d_loadtest_endpoints", *by_endpoint(_S1))
add("d_loadtest_errors", *by_error(_S1))
for _dash, _where, _rps, _lat, _gauge in (("dotnet", "service_name = 'svc-2'", "aspnet_rps", "aspnet_latency", "kestrel"),
                                          ("python", "true", "http_rps", "http_latency", "active")):
    add(f"d_{_dash}_rate", SPANS, span_series(_RATE, _where))
    add(f"d_{_dash}_errors", SPANS, span_series(_SHARE, _where))
    add(f"d_{_dash}_p95", SPANS, span_series(_P95, _where))
    add(f"d_{_dash}_{_rps}", *rate(_where))
    add(f"d_{_dash}_{_lat}", snapshots(_where), percentiles())
    add(f"d_{_dash}_{_gauge}", *gauge("active", _where))
    add(f"d_{_dash}_routes", SPANS, routes(_where))

# ------------------------------------------------------------ examples

add("e1_spans_by_service", SPANS, """SELECT service_name, count(*) AS spans, round(sum((duration_ms*1e6)::BIGINT)::DOUBLE/count(*)/1e6, 2) AS avg_ms FROM spans GROUP BY 1""")
add("e2_p95_by_service", SPANS, "SELECT service_name, round(quantile_cont(duration_ms, 0.95), 2) AS p95_ms FROM spans GROUP BY 1")
add("e3_error_traces", SPANS, "SELECT trace_id, span_name, status_message, duration_ms FROM spans WHERE status_code = 2 ORDER BY start_ns DESC, span_id LIMIT 100")
add("e4_slowest_spans", SPANS, "SELECT span_name, service_name, duration_ms, span_attributes FROM spans ORDER BY duration_ms DESC, span_id LIMIT 50")
add("e5_logs_by_severity", LOGS, "SELECT severity_text, count(*) AS n FROM logs GROUP BY 1")
add("e6_recent_error_logs", LOGS, "SELECT time_ns//1000 AS ts, service_name, body FROM logs WHERE severity_number >= 17 ORDER BY time_ns DESC, service_name, body LIMIT 100")
add("e7_gauge_values", PTS, """SELECT metric_name, service_name, ts_ns/1e9 AS ts, value_double FROM pts WHERE metric_type = 'gauge'
  ORDER BY ts_ns DESC, metric_name, service_name, series_attributes LIMIT 500""")
add("e8_histogram_means", PTS, """SELECT metric_name, service_name, round(hist_sum/hist_count, 3) AS mean FROM pts WHERE hist_count > 0
  ORDER BY ts_ns DESC, metric_name, service_name, series_attributes, resource_attributes LIMIT 200""")

# ------------------------------------------------------------ result shapes

add("c1_point_value", PTS, """SELECT metric_name, service_name, series_attributes, ts_ns, CASE metric_type WHEN 'histogram' THEN CASE WHEN hist_count > 0 THEN hist_sum/hist_count END
  WHEN 'summary' THEN CASE WHEN summary_count > 0 THEN summary_sum/summary_count END
  WHEN 'exponential_histogram' THEN (exp_zero_count + coalesce(list_sum((exp_buckets->'$.positive.bucket_counts')::BIGINT[]), 0)
    + coalesce(list_sum((exp_buckets->'$.negative.bucket_counts')::BIGINT[]), 0))::DOUBLE
  ELSE coalesce(value_double, value_int) END AS v FROM pts""")
add("c2_series_wide", PTS, "SELECT ts_ns/1e6 AS t_ms, " + ", ".join(
    f"""max(CASE WHEN service_name = 'svc-{s}' AND series_attributes = '{{"host":"h-{h}"}}' THEN coalesce(value_double, value_int) END) AS svc{s}_h{h}"""
    for s in range(5) for h in range(2)) + " FROM pts WHERE metric_name = 'app.value' GROUP BY 1")
_LAST = "SELECT * FROM pts WHERE metric_name = '{}' ORDER BY ts_ns DESC, service_name DESC, series_attributes DESC, resource_attributes DESC LIMIT 1"
add("c3_histogram_buckets", PTS + f", last AS ({_LAST.format('app.duration')})", """SELECT (k - 1)::INTEGER AS i, CASE k WHEN 1 THEN '≤5' WHEN 2 THEN '≤25' WHEN 3 THEN '≤100' ELSE '>100' END AS bucket, count
  FROM (SELECT unnest(hist_bucket_counts::DOUBLE[]) AS count, unnest([1, 2, 3, 4]) AS k FROM last)""")
add("c4_exponential_buckets", PTS + f", last AS ({_LAST.format('app.latency.exp')}), b AS (SELECT exp_scale, exp_zero_count, exp_zero_threshold, (exp_buckets->'$.positive.bucket_counts')::BIGINT[] AS pc, (exp_buckets->>'$.positive.offset')::INTEGER AS po, (exp_buckets->'$.negative.bucket_counts')::BIGINT[] AS nc, coalesce((exp_buckets->>'$.negative.offset')::INTEGER, 0) AS no FROM last)",
    """SELECT 'zero' AS side, 0::INTEGER AS i, 'zero' AS bucket, exp_zero_count AS count, exp_zero_threshold AS upper_bound FROM b
  UNION ALL SELECT 'positive', k::INTEGER, '2^' || (po + k - 2), c, round(pow(2, (po + k) / 2.0), 6) FROM (SELECT po, unnest(pc) AS c, generate_subscripts(pc, 1) AS k FROM b)
  UNION ALL SELECT 'negative', k::INTEGER, NULL, c, -round(pow(2, (no + k) / 2.0), 6) FROM (SELECT no, unnest(nc) AS c, generate_subscripts(nc, 1) AS k FROM b)""")
add("c5_summary_quantiles", PTS + f", last AS ({_LAST.format('app.quantiles')}), q AS (SELECT unnest((summary_quantiles::JSON)->'$[*]') AS e FROM last)",
    "SELECT (e->>'$.quantile')::DOUBLE AS q, (e->>'$.value')::DOUBLE AS v FROM q WHERE isfinite((e->>'$.value')::DOUBLE)")
ORACLE["c6_waterfall"] = f"""WITH RECURSIVE {SPANS}, tree AS (SELECT trace_id, span_id, 0 AS depth FROM spans WHERE parent_span_id IS NULL
  UNION ALL SELECT s.trace_id, s.span_id, t.depth + 1 FROM tree t JOIN spans s ON s.trace_id = t.trace_id AND s.parent_span_id = t.span_id),
  ext AS (SELECT trace_id, min(start_ns) AS lo, greatest(max(end_ns) - min(start_ns), 1) AS total FROM spans GROUP BY 1)
  SELECT s.trace_id, s.span_id, depth::BIGINT AS depth, (start_ns - lo)/total::DOUBLE*100.0::DOUBLE AS left_pct,
  greatest((end_ns - start_ns)/total::DOUBLE*100.0::DOUBLE, 0.5) AS width_pct FROM spans s JOIN tree USING (trace_id, span_id) JOIN ext ON ext.trace_id = s.trace_id"""
add("c7_line", snapshots(), f"SELECT (ts//1000)::DOUBLE AS x, p50, p95, p99 FROM ({percentiles()})")
add("c8_scatter", SPANS, "SELECT start_ns/1e6 AS x, duration_ms, status_code::DOUBLE AS status_code FROM spans")
add("c9_bar", SPANS, f"SELECT route AS label, requests::DOUBLE AS requests FROM ({routes()})")
add("c10_value_histogram", SPANS, """SELECT g.i::INTEGER AS i, lo + g.i*w AS x0, lo + (g.i + 1)*w AS x1, count(v.d) AS count FROM (
  SELECT lo, w, k, unnest(range(k)) AS i FROM (SELECT *, (hi - lo)/k AS w FROM (SELECT min(duration_ms) AS lo, max(duration_ms) AS hi,
  least(greatest(ceil(log2(count(*))) + 1, 5), 40)::BIGINT AS k FROM spans))) g LEFT JOIN (SELECT duration_ms AS d FROM spans) v
  ON least(g.k - 1, floor((v.d - g.lo)/g.w)) = g.i GROUP BY 1, 2, 3""")
_HEAT = heat()
add("c11_heat_grid", _HEAT[0], f"""SELECT (ts//1000)::DOUBLE AS x, y, weight, weight/(SELECT greatest(max(weight), 1.0) FROM ({_HEAT[1]})) AS share FROM ({_HEAT[1]})""")
add("c12_last_numeric", PTS, "SELECT arg_max(value_double, (ts_ns, service_name)) FILTER (value_double IS NOT NULL) AS last_value FROM pts WHERE metric_name = 'app.value'")
add("c13_span_events", EV, f"""SELECT {_TRACE} AS trace_id, {_SPAN} AS span_id, 0::INTEGER AS i, 'evt.' || event_type AS name, us*1000 AS time_ns,
  '{{"k":' || (event_id % 9) || '}}' AS attributes, 0::BIGINT AS dropped_attributes_count FROM ev WHERE event_id % 5 = 0""")
add("c13_span_links", EV, f"""SELECT {_TRACE} AS trace_id, {_SPAN} AS span_id, 0::INTEGER AS i, {_TRACE} AS to_trace_id, {_SPAN} AS to_span_id, '' AS trace_state,
  '{{}}' AS attributes, 0::BIGINT AS dropped_attributes_count, 1::BIGINT AS flags FROM ev WHERE event_id % 7 = 0""")
add("c14_attribute_rows", SPANS, """SELECT span_id, 'span_attributes' AS origin, unnest(['http.route', 'n']) AS key, unnest([json_extract_string(span_attributes, '$."http.route"'), span_attributes->>'$.n']) AS value
  FROM spans WHERE span_attributes IS NOT NULL UNION ALL SELECT span_id, 'resource_attributes', unnest(['service.name', 'service.instance.id']),
  unnest([service_name, json_extract_string(resource_attributes, '$."service.instance.id"')]) FROM spans""")
add("t5_stream_all_counts", ALL, """SELECT 'spans' AS signal, count(*) AS n FROM spans UNION ALL SELECT 'log_records', count(*) FROM logs
  UNION ALL SELECT 'metric_points', count(*) FROM pts""")
add("t5_stream_counts", ALL, "SELECT 'spans' AS signal, count(*) AS n FROM spans UNION ALL SELECT 'log_records', count(*) FROM logs")
for _key in ("g2_cte_chain",):
    ORACLE[_key] = ORACLE[_key].replace("FROM sp0)\n, slow", "FROM sp0), slow")
