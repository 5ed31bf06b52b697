"""Hand-made edge tables."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from signalmill.operators import counters, filters, histograms, metrics, shaping, traces
from signalmill.operators.skew import balanced_edges
from signalmill.schemas import METRIC_POINTS, SPANS

S = 1_000_000_000


def points(spark, *given, metric="m"):
    base = {f.name: None for f in METRIC_POINTS.fields} | {
        "metric_name": metric, "metric_type": "histogram", "service_name": "s", "flags": 0, "aggregation_temporality": 2}
    return spark.createDataFrame([tuple((base | g)[f.name] for f in METRIC_POINTS.fields) for g in given], METRIC_POINTS)


def spans(spark, *given):
    base = {f.name: None for f in SPANS.fields} | {
        "trace_id": "t", "span_name": "n", "span_kind": 0, "service_name": "s", "status_code": 0, "duration_ms": 0.0, "start_ns": 0,
        "end_ns": 10, "dropped_attributes_count": 0, "dropped_events_count": 0, "dropped_links_count": 0, "flags": 0}
    return spark.createDataFrame([tuple((base | g)[f.name] for f in SPANS.fields) for g in given], SPANS)


def test_counter_reset_single_point_and_null_series(spark):
    df = points(spark, *[{"ts_ns": t * S, "hist_count": c, "series_attributes": a} for a, t, c in [
        ('{"name":"a"}', 1, 5), ('{"name":"a"}', 700, 9), ('{"name":"a"}', 1400, 2), ('{"name":"a"}', 1401, 6),
        ('{"name":"b"}', 3, 7), (None, 1, 1), (None, 2, 4), ('{"name":"a"}', 1402, 0)]])
    rises = counters.counter_increase(counters.observed(df, "m"))
    assert rows(rises.select("series_attributes", "ts_ns", "inc_hist_count")) == sorted([
        ('{"name":"a"}', 1 * S, 0), ('{"name":"a"}', 700 * S, 4), ('{"name":"a"}', 1400 * S, 0), ('{"name":"a"}', 1401 * S, 4),
        ('{"name":"b"}', 3 * S, 0), (None, 1 * S, 0), (None, 2 * S, 3)], key=repr)
    assert counters.increase_total(df, "m").first()["requests"] == 11
    by = rows(counters.increase_by(df, "m", "name", "endpoint"))
    assert by == [("a", 8), ("b", 0)]
    assert rows(counters.increase_by(df, "m", "error.type", "error_type", "(ok)")) == [("(ok)", 11)]


def test_edges_give_the_same_increases(spark):
    df = points(spark, *[{"ts_ns": t if t < 300 else t * S, "hist_count": (t * 7) % 50, "series_attributes": f'{{"name":"{t % 2}"}}'} for t in range(1, 400)])
    edges = balanced_edges(df, "ts_ns", 8)
    assert rows(counters.increase_by(df, "m", "name", "endpoint", edges=edges)) == rows(counters.increase_by(df, "m", "name", "endpoint"))
    assert rows(counters.rate(df, "m", edges=edges)) == rows(counters.rate(df, "m"))


def test_sum_of_increases_is_last_minus_first(spark):
    df = points(spark, *[{"ts_ns": t * 37 * S, "hist_count": 3 + t * t, "series_attributes": "{}"} for t in range(200)])
    assert counters.increase_total(df, "m").first()["requests"] == 199 * 199


def test_endpoint_stats_with_nameless_series_and_without_rows(spark):
    df = points(spark, *[{"ts_ns": t * S, "hist_count": c, "hist_sum": float(c) / 10, "hist_max": x, "series_attributes": a} for a, t, c, x in [
        ('{"name":"a"}', 0, 10, 0.5), ('{"name":"a"}', 10, 30, 0.7), ('{"k":1}', 0, 1, 0.9), ('{"k":1}', 10, 6, 0.9),
        ('{"error.type":"E","name":"a"}', 0, 1, 0.1), ('{"error.type":"E","name":"a"}', 5, 6, 0.2)]])
    got = [tuple(r) for r in counters.endpoint_stats(df, "m").collect()]
    assert got == [("(no name)", 5, "0 (0.0%)", 100.0, 900.0, 0.5), ("a", 25, "5 (20.0%)", 100.0, 700.0, 2.5),
                   ("Total", 30, "5 (16.7%)", 100.0, 900.0, 3.0)]
    empty = [tuple(r) for r in counters.endpoint_stats(df, "other").collect()]
    assert empty == [("Total", None, None, None, 0.0, None)]


@pytest.mark.parametrize("bounds,counts,want", [
    ("[1.0,2.0]", "[0,0,9]", (2.0, 2.0, 2.0)),                      # all in the open bucket
    ('[1.0,2.0,"inf"]', "[5,5,0]", (1.0, 2.0, 2.0)),                # infinite bound given
    (None, "[4]", (None, None, None)),                              # no bounds
    ("[1.0]", None, (1.0, 1.0, 1.0)),                               # no counts
    ("[2.0,1.0]", "[1,9,0]", (1.0, 2.0, 2.0)),                      # bounds out of order
    ("[0.0015,0.0025]", "[10,10,0]", (0.002, 0.003, 0.003)),        # rounded to three digits
])
def test_percentiles(spark, bounds, counts, want):
    df = points(spark, {"ts_ns": 5 * S, "hist_count": 9, "hist_bounds": bounds, "hist_bucket_counts": counts})
    got = histograms.histogram_percentiles(df, "m").collect()
    assert [tuple(r)[1:] for r in got] == [want]


def test_percentile_of_open_bucket_is_infinite_without_fallback(spark):
    df = points(spark, {"ts_ns": 5 * S, "hist_count": 9, "hist_bounds": "[1.0]", "hist_bucket_counts": "[0,9]"})
    assert histograms.histogram_percentiles(df, "m", qs=(0.95,), finite_only=False).first()["p95"] == float("inf")


def test_percentiles_rise_with_the_share(spark):
    df = points(spark, *[{"ts_ns": t * 60 * S, "hist_count": 1, "hist_bounds": "[1.0,2.0,4.0,8.0]",
                          "hist_bucket_counts": str([(t * k) % 7 for k in (1, 2, 3, 5, 6)])} for t in range(40)])
    for r in histograms.histogram_percentiles(df, "m").collect():
        assert r["p50"] <= r["p95"] <= r["p99"]


def test_latest_point_wins_and_ties_are_stable(spark):
    df = points(spark, {"ts_ns": 1 * S, "hist_count": 1, "hist_bounds": "[1.0]", "hist_bucket_counts": "[1,0]"},
                {"ts_ns": 2 * S, "hist_count": 1, "service_name": "a", "hist_bounds": "[5.0]", "hist_bucket_counts": "[1,0]"},
                {"ts_ns": 2 * S, "hist_count": 1, "service_name": "b", "hist_bounds": "[7.0]", "hist_bucket_counts": "[1,0]"})
    assert histograms.histogram_percentiles(df, "m").first()["p50"] == 7.0
    heat = histograms.latency_heatmap(df, "m").collect()
    assert [(r["y"], r["weight"]) for r in heat] == [(0.0, 1.0), (7.0, 0.0)]


def test_delta_and_cumulative_rates_agree(spark):
    cumulative = points(spark, *[{"ts_ns": t * S, "start_ns": 0, "hist_count": 4 * t} for t in range(1, 6)])
    delta = points(spark, *[{"ts_ns": t * S, "start_ns": (t - 1) * S, "hist_count": 4, "aggregation_temporality": 1} for t in range(2, 6)])
    assert rows(counters.rate(cumulative, "m")) == rows(counters.rate(delta, "m"))


def chain(n, parent_of=lambda i: i - 1):
    return [{"span_id": f"{i:03}", "parent_span_id": None if parent_of(i) is None or parent_of(i) < 0 else f"{parent_of(i):03}",
             "start_ns": i, "end_ns": i + 5} for i in range(n)]


def test_depth_of_deep_chain_orphan_cycle_and_repeated_id(spark):
    other = [{"trace_id": "u", **s} for s in (
        {"span_id": "o", "parent_span_id": "missing"}, {"span_id": "oc", "parent_span_id": "o"},
        {"span_id": "x", "parent_span_id": "y"}, {"span_id": "y", "parent_span_id": "x"}, {"span_id": "z", "parent_span_id": "z"},
        {"span_id": "e", "parent_span_id": ""}, {"span_id": "d", "parent_span_id": "o", "start_ns": 1},
        {"span_id": "d", "parent_span_id": None, "start_ns": 2})]
    depth = {(r["trace_id"], r["span_id"]): r["depth"] for r in traces.span_depths(spans(spark, *chain(100), *other)).collect()}
    assert [depth["t", f"{i:03}"] for i in range(100)] == list(range(100))
    assert {k[1]: v for k, v in depth.items() if k[0] == "u"} == {"o": 0, "oc": 1, "x": 65, "y": 65, "z": 65, "e": 0, "d": 0}


def test_spans_that_share_an_id_follow_their_own_parent(spark):
    given = spans(spark, {"span_id": "o"}, {"span_id": "d", "parent_span_id": "o", "start_ns": 1, "span_name": "first"},
                  {"span_id": "d", "parent_span_id": "", "start_ns": 2, "span_name": "second"},
                  {"span_id": "c", "parent_span_id": "d", "start_ns": 3, "span_name": "child"})
    assert {r["span_name"]: r["depth"] for r in traces.waterfall(given).collect()} == {"n": 0, "first": 1, "second": 0, "child": 1}


def test_exponential_buckets(spark):
    shape = lambda zero, buckets: [tuple(r) for r in metrics.exponential_buckets(points(spark, {
        "ts_ns": 1, "exp_zero_count": zero, "exp_scale": 0, "exp_zero_threshold": 0.0, "exp_buckets": buckets}), "m").collect()]
    assert shape(0, '{"negative":null,"positive":null}') == []
    assert shape(0, '{"negative":{"bucket_counts":[2],"offset":1},"positive":{"bucket_counts":[3,4],"offset":-1}}') == [
        ("zero", 0, "zero", 0, 0.0), ("positive", 1, "2^-2", 3, 1.0), ("positive", 2, "2^-1", 4, 2.0), ("negative", 1, None, 2, -4.0)]


def test_waterfall_of_one_hot_trace(spark):
    wide = chain(1) + [{"span_id": f"{i:03}", "parent_span_id": "000", "start_ns": i, "end_ns": i} for i in range(1, 400)]
    got = traces.waterfall(spans(spark, *wide))
    assert got.count() == 400
    assert got.where("depth = 1").count() == 399
    r = got.where("span_id = '200'").first()
    assert r["left_pct"] == pytest.approx(200 / 399 * 100) and r["width_pct"] == 0.5


def test_search_text_with_special_characters(spark):
    df = spark.createDataFrame([("50%_a\\b",), ("50xya\\b",), ("plain",), (None,)], "name string")
    hit = lambda q: df.where(filters.contains(q, "name")).count()
    assert hit("a\\b") == 2          # the backslash is an ordinary character
    assert hit("50%A") == 2 and hit("50__a") == 2 and hit("%") == 3 and hit("") == 3 and hit("PLAIN") == 1


def test_severity_and_ranges():
    assert [filters.severity_min(x) for x in ("Error", "warning", "12", "odd")] == [17, 13, 12, None]
    assert filters.time_range("all") == (0, filters.ALL_TO_NS)
    assert filters.time_range("5m", now_ms=1_000_000) == (700_000 * 1_000_000, 1_000_000 * 1_000_000)
    assert filters.time_range("custom", 1, 2) == (1_000_000, 2_000_000)
    assert filters.shift_range((5_000_000, 9_000_000), -10) == (0, -1_000_000)
    assert filters.jump_to((10, 30), 100) == (80, 100)
    assert filters.page_size(None, 100) == 100 and filters.page_size(0, 100) == 1 and filters.page_size(10 ** 9, 100) == 10 ** 9


def test_last_value_ignores_missing_values(spark):
    df = points(spark, {"ts_ns": 1, "value_double": 3.0, "metric_type": "gauge"}, {"ts_ns": 2, "value_int": 9, "metric_type": "gauge"})
    assert metrics.metric_summary(df).first()["last_value"] == 3.0
    assert metrics.metric_summary(df, any_value=True).first()["last_value"] == 9.0
    assert metrics.metric_detail(df, "nope").metadata.isEmpty()
    assert [r["ts_ns"] for r in metrics.metric_detail(df, "m", limit=1).points.collect()] == [1]
    assert [r["ts_ns"] for r in metrics.metric_detail(df, "m", limit=1, newest=True).points.collect()] == [2]


def test_summary_pairs_and_unparsable_text(spark):
    df = points(spark, {"ts_ns": 1, "summary_quantiles": '[[0.5,2],{"quantile":0.1,"value":1},{"quantile":0.9,"value":"NaN"},7]'})
    assert [tuple(r) for r in metrics.summary_quantiles(df, "m").collect()] == [(0.1, 1.0), (0.5, 2.0)]
    broken = points(spark, {"ts_ns": 1, "summary_quantiles": "not json", "hist_bucket_counts": "oops"})
    assert metrics.summary_quantiles(broken, "m").count() == 0 and metrics.histogram_buckets(broken, "m").count() == 0


def test_shapes(spark):
    df = spark.createDataFrame([(1_700_000_000 + i, "2.5" if i % 2 else None, f"r{i}", float("nan") if i == 3 else i * 1.0) for i in range(6)],
                               "when_s long, text string, label string, v double")
    line = shaping.line(df)
    assert (line.x, line.values) == ("when_s", ["text", "v"])
    assert [tuple(r) for r in line.rows.limit(2).collect()] == [(1_700_000_000_000.0, None, 0.0), (1_700_000_001_000.0, 2.5, 1.0)]
    assert shaping.line(df.select("label")) is None and shaping.line(df.limit(1)) is None
    bar = shaping.bar(df)
    assert (bar.x, bar.values) == ("label", ["when_s", "text", "v"])
    scatter = shaping.scatter(df.select("v", "when_s"))
    assert scatter.x == "when_s" and scatter.rows.first()["x"] == 1_700_000_000.0
    hist = shaping.value_histogram(df, "v").collect()
    assert sum(r["count"] for r in hist) == 5 and len(hist) == 5
    assert shaping.value_histogram(df.limit(2), "v").count() == 0
    assert shaping.last_numeric(df, ["when_s"], "text").first()["last_value"] == 2.5


def test_time_column_is_chosen_from_all_rows(spark):
    # For 99 rows "time_text" reads as a time, in the last one it does not; "moment" does in all of them.
    df = spark.createDataFrame([(f"2024-01-01 00:00:{i % 60:02d}" if i < 99 else "late", 1_700_000_000 + i, i * 1.0) for i in range(100)],
                               "time_text string, moment long, v double").coalesce(1)
    line = shaping.line(df)
    assert (line.x, line.values, line.rows.count()) == ("moment", ["v"], 100)
    assert shaping.line(df.select("time_text", "v")) is None
