"""Optional filters. A filter that is not set adds no predicate to the plan."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsontext import attribute
from ..functions.timeutil import event_date
from ..schemas import SEVERITY_MIN

# Time range presets in milliseconds; "all" has no width.
PRESETS_MS = {"all": None, "5m": 300_000, "10m": 600_000, "15m": 900_000, "30m": 1_800_000,
              "1h": 3_600_000, "3h": 10_800_000, "6h": 21_600_000, "12h": 43_200_000,
              "24h": 86_400_000, "7d": 604_800_000}
ALL_TO_NS = 9_200_000_000_000_000_000


def contains(q: str, *columns: str) -> Column:
    """``column ILIKE %q%`` over any of the columns; ``%`` and ``_`` in q stay wildcards."""
    escape = next(c for c in map(chr, range(1, 32)) if c not in q)
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.ilike(F.col(name), F.lit(f"%{q}%"), F.lit(escape)), F.lit(False))
    return found


def severity_min(text: str) -> int | None:
    """Lowest severity number of a name or number; None (no filter) when unknown."""
    known = SEVERITY_MIN.get(text.lower())
    if known is not None:
        return known
    try:
        return int(text)
    except ValueError:
        return None


def _bound(v: int | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("bigint")


def between_ns(df: DataFrame, column: str, start_ns: int | Column | None = None,
               end_ns: int | Column | None = None) -> DataFrame:
    """Inclusive time range, repeated on the ``event_date`` partition where the table has it."""
    dated = "event_date" in df.columns
    if start_ns is not None:
        df = df.where(F.col(column) >= _bound(start_ns))
        if dated:
            df = df.where(F.col("event_date") >= event_date(_bound(start_ns)))
    if end_ns is not None:
        df = df.where(F.col(column) <= _bound(end_ns))
        if dated:
            df = df.where(F.col("event_date") <= event_date(_bound(end_ns)))
    return df


def attribute_column(df: DataFrame, json_column: str, key: str) -> Column:
    """An attribute as text: the column promoted at write time, or the JSON text where a file was written without it."""
    promoted = promoted_name(json_column, key)
    text = attribute(F.col(json_column), key)
    return F.coalesce(F.col(f"`{promoted}`"), text) if promoted in df.columns else text


def promoted_name(json_column: str, key: str) -> str:
    return f"{json_column}:{key}"


def attributes_equal(df: DataFrame, json_column: str, wanted: dict[str, str | None]) -> DataFrame:
    for key, value in wanted.items():
        if value in (None, ""):
            continue
        promoted = promoted_name(json_column, key)
        if promoted in df.columns:  # pushed down; keeps the rows of files without the column for the test below
            df = df.where((F.col(f"`{promoted}`") == value) | F.col(f"`{promoted}`").isNull())
        df = df.where(attribute_column(df, json_column, key) == value)
    return df


def filter_spans(spans: DataFrame, service: str | None = None, q: str | None = None,
                 start_ns: int | None = None, end_ns: int | None = None,
                 min_duration_ms: float | None = None) -> DataFrame:
    out = between_ns(spans, "start_ns", start_ns)
    if end_ns is not None:
        out = out.where(F.col("end_ns") <= _bound(end_ns))
        if "event_date" in out.columns:  # a span starts on the day of its end or before
            out = out.where(F.col("event_date") <= event_date(_bound(end_ns)))
    if service is not None:
        out = out.where(F.col("service_name") == service)
    if q is not None:
        out = out.where(contains(q, "span_name", "trace_id"))
    if min_duration_ms is not None:
        out = out.where(F.col("end_ns") - F.col("start_ns") >= int(min_duration_ms * 1e6))
    return out


def filter_logs(logs: DataFrame, service: str | None = None, q: str | None = None,
                severity: str | None = None, start_ns: int | None = None, end_ns: int | None = None,
                trace_id: str | Column | None = None, span_id: str | Column | None = None) -> DataFrame:
    out = between_ns(logs, "time_ns", start_ns, end_ns)
    if service is not None:
        out = out.where(F.col("service_name") == service)
    lowest = severity_min(severity) if severity else None
    if lowest is not None:
        out = out.where(F.col("severity_number") >= lowest)
    if q is not None:
        out = out.where(contains(q, "body", "log_attributes", "severity_text", "event_name"))
    if trace_id is not None:
        out = out.where(F.col("trace_id") == trace_id)
    if span_id is not None:
        out = out.where(F.col("span_id") == span_id)
    return out


def filter_metrics(points: DataFrame, service: str | None = None, q: str | None = None) -> DataFrame:
    out = points
    if service is not None:
        out = out.where(F.col("service_name") == service)
    if q is not None:
        out = out.where(contains(q, "metric_name", "metric_description"))
    return out


def filter_points(points: DataFrame, metric: str, service: str | None = None,
                  from_ns: int | Column | None = None, to_ns: int | Column | None = None,
                  series: dict[str, str | None] | None = None,
                  resource: dict[str, str | None] | None = None) -> DataFrame:
    """One metric, narrowed by service, time range, series and resource attributes."""
    out = points.where(F.col("metric_name") == metric)
    if service:
        out = out.where(F.col("service_name") == service)
    out = between_ns(out, "ts_ns", from_ns, to_ns)
    out = attributes_equal(out, "series_attributes", series or {})
    return attributes_equal(out, "resource_attributes", resource or {})


def select_spans(spans: DataFrame, service: str | None = None, from_ns: int | Column | None = None,
                 to_ns: int | Column | None = None, attributes: dict[str, str | None] | None = None) -> DataFrame:
    """Spans started in a range, narrowed by service and span attributes."""
    out = between_ns(spans, "start_ns", from_ns, to_ns)
    if service:
        out = out.where(F.col("service_name") == service)
    return attributes_equal(out, "span_attributes", attributes or {})


def page_size(limit: int | None, default: int) -> int:
    """The caller's limit, whatever its size; a server clamps it if it must."""
    return max(1, default if limit is None else limit)


def time_range(preset: str = "all", from_ms: float | None = None, to_ms: float | None = None,
               now_ms: float | None = None) -> tuple[int, int]:
    """``(from_ns, to_ns)`` of a preset, or of ``from_ms``/``to_ms`` with preset ``custom``."""
    if preset == "all":
        return 0, ALL_TO_NS
    if preset == "custom" and from_ms is not None and to_ms is not None:
        return int(from_ms * 1e6), int(to_ms * 1e6)
    width = PRESETS_MS.get(preset) or PRESETS_MS["1h"]
    end = to_ms if to_ms is not None else (now_ms if now_ms is not None else time.time() * 1000)
    return int(end - width) * 1_000_000, int(end) * 1_000_000


def shift_range(bounds: tuple[int, int], ms: int) -> tuple[int, int]:
    """Moves a range by ``ms``; its start never falls below zero."""
    return max(0, bounds[0] + ms * 1_000_000), bounds[1] + ms * 1_000_000


def jump_to(bounds: tuple[int, int], now_ns: int) -> tuple[int, int]:
    """A range of the same width that ends at ``now_ns``."""
    return now_ns - (bounds[1] - bounds[0]), now_ns


def preset_range(df: DataFrame, column: str, preset: str) -> DataFrame:
    """Rows of a preset range anchored at the newest row, so that replays are stable."""
    width = PRESETS_MS[preset]
    if width is None:
        return between_ns(df, column, 0, ALL_TO_NS)
    newest = df.agg(F.max(column)).scalar()
    return df.where(F.col(column).between(newest - width * 1_000_000, newest))
