"""Dashboards: named inputs and the panels that use them.

A panel is a function of the signal tables, a time range and input values. An
empty input means no filter and adds nothing to the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..operators import counters, histograms, red
from ..operators.catalog import attribute_options, services
from .console import check_read_only



class Input(NamedTuple):
    name: str
    kind: str  # "service", "attribute" or "select"
    table: str = ""
    key: str = ""
    resource: bool = False
    choices: tuple[str, ...] = ()


class Panel(NamedTuple):
    id: str
    title: str
    kind: str
    build: Callable[..., DataFrame]
    unit: str = ""


class Dashboard(NamedTuple):
    name: str
    title: str
    inputs: tuple[Input, ...]
    panels: tuple[Panel, ...]


def _where(inputs: dict, from_ns, to_ns, series: dict[str, str], instance: bool = False) -> dict:
    """Filter arguments for metric points: which inputs narrow which series attribute."""
    where = {"service": inputs.get("service") or None, "from_ns": from_ns, "to_ns": to_ns,
             "series": {key: inputs.get(name) for name, key in series.items()}}
    if instance:
        where["resource"] = {"service.instance.id": inputs.get("instance")}
    return where


def _points(operator, metric: str, series: dict[str, str] | None = None, instance: bool = False, **options):
    def build(tables, from_ns=None, to_ns=None, metric_name=metric, **inputs):
        extra = {k: inputs.pop(k) for k in ("width_ns",) if k in inputs}
        where = _where(inputs, from_ns, to_ns, series or {}, instance)
        return operator(tables["metric_points"], metric_name, **options, **extra, **where)
    return build


def _spans(operator, by_route: bool = True):
    def build(tables, from_ns=None, to_ns=None, **inputs):
        extra = {k: inputs[k] for k in ("width_ns",) if k in inputs}
        where = {"service": inputs.get("service") or None, "from_ns": from_ns, "to_ns": to_ns}
        if by_route:
            where["attributes"] = {"http.route": inputs.get("route")}
        return operator(tables["spans"], **extra, **where)
    return build


_BOTH = {"route": "name", "err": "error.type"}
# Metric names the dashboards read.
_DURATION, _USERS = "locust.client.duration", "locust.current_users"

LOAD_TEST = Dashboard("loadtest", "Load test", (
    Input("service", "service"), Input("route", "attribute", "metric_points", "name"),
    Input("err", "attribute", "metric_points", "error.type"),
    Input("instance", "attribute", "metric_points", "service.instance.id", True),
), (
    Panel("stats", "Endpoint stats", "table", _points(counters.endpoint_stats, _DURATION, _BOTH, True)),
    Panel("users_now", "Users (now)", "dial",
          _points(partial(counters.gauge_series, latest=True, value="users"), _USERS, None, True), "users"),
    Panel("requests_total", "Requests (in range)", "stat", _points(counters.increase_total, _DURATION, _BOTH, True), "req"),
    Panel("users", "Users over time", "line",
          _points(partial(counters.gauge_series, value="users"), _USERS, None, True), "users"),
    Panel("rps", "Requests / second", "line", _points(counters.counter_rate, _DURATION, _BOTH, True), "req/s"),
    Panel("latency", "Latency percentiles", "line", _points(histograms.histogram_percentiles, _DURATION, _BOTH, True), "s"),
    Panel("heatmap", "Latency distribution over time", "heatmap",
          _points(histograms.latency_heatmap, _DURATION, {"route": "name"}, True), "req"),
    Panel("endpoints", "Requests by endpoint", "bar",
          _points(partial(counters.increase_by, attr="name", label="endpoint"), _DURATION, {"err": "error.type"}, True), "req"),
    Panel("errors", "Requests by error type", "bar",
          _points(partial(counters.increase_by, attr="error.type", label="error_type", null_label="(ok)"),
                  _DURATION, {"route": "name"}, True), "req"),
))


def _service_dashboard(name: str, title: str, rate_id: str, latency_id: str, gauge_id: str,
                       histogram: str, gauge: str, latency_unit: str) -> Dashboard:
    by_route = {"route": "http.route"}
    return Dashboard(name, title, (Input("service", "service"), Input("route", "attribute", "spans", "http.route")), (
        Panel("rate", "Requests / second (spans)", "line", _spans(red.span_rate), "req/s"),
        Panel("errors", "Error share", "line", _spans(red.span_error_share), "%"),
        Panel("p95", "Span duration p95", "line", _spans(red.span_quantile), "ms"),
        Panel(rate_id, "Request rate (histogram)", "line", _points(counters.counter_rate, histogram, by_route), "req/s"),
        Panel(latency_id, "Latency percentiles", "line",
              _points(histograms.histogram_percentiles, histogram, by_route), latency_unit),
        Panel(gauge_id, "Active", "line", _points(partial(counters.gauge_series, value="active"), gauge)),
        Panel("routes", "Top routes", "bar", _spans(red.top_routes, by_route=False), "req"),
    ))


DOTNET = _service_dashboard(
    "dotnet", ".NET service", "aspnet_rps", "aspnet_latency", "kestrel",
    "Microsoft.AspNetCore.Hosting.RequestDuration", "Microsoft.AspNetCore.Server.Kestrel.ActiveConnections", "s")
PYTHON = _service_dashboard(
    "python", "Python service", "http_rps", "http_latency", "active",
    "http.server.duration", "http.server.active_requests", "ms")

DASHBOARDS = {d.name: d for d in (LOAD_TEST, DOTNET, PYTHON)}


def run_panel(tables: dict[str, DataFrame], dashboard: str, panel: str, from_ns=None, to_ns=None, **inputs) -> DataFrame:
    """One panel as a DataFrame, without the row cap of the display."""
    chosen = {p.id: p for p in DASHBOARDS[dashboard].panels}[panel]
    return chosen.build(tables, from_ns=from_ns, to_ns=to_ns, **inputs)


def run_dashboard(tables: dict[str, DataFrame], dashboard: str, from_ns=None, to_ns=None,
                  max_rows: int | None = None, **inputs) -> dict[str, DataFrame]:
    """All panels of a dashboard, whole unless ``max_rows`` is set; nothing runs until a panel is read."""
    out = {}
    for panel in DASHBOARDS[dashboard].panels:
        df = panel.build(tables, from_ns=from_ns, to_ns=to_ns, **inputs)
        out[panel.id] = df if max_rows is None else df.limit(max_rows)
    return out


def run_custom_panel(spark: SparkSession, sql: str, from_ns: int, to_ns: int, **inputs) -> DataFrame:
    """A panel written in SQL over the registered views.

    The text uses ``:from_ns``, ``:to_ns`` and one parameter per input; an empty
    input is NULL, so ``(:x IS NULL OR col = :x)`` filters only when it is set.
    """
    args = {"from_ns": from_ns, "to_ns": to_ns, **{k: (v if v != "" else None) for k, v in inputs.items()}}
    return spark.sql(check_read_only(sql), args=args)


def input_options(tables: dict[str, DataFrame], dashboard: str, name: str) -> DataFrame:
    """Choices of an input, as a column ``v``."""
    chosen = {i.name: i for i in DASHBOARDS[dashboard].inputs}[name]
    if chosen.kind == "service":
        return services(tables).toDF("v").orderBy("v")
    if chosen.kind == "attribute":
        return attribute_options(tables, chosen.table, chosen.key, chosen.resource)
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(c,) for c in chosen.choices], "v string")
