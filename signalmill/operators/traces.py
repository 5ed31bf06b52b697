"""Trace summaries, details, correlation and waterfalls."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .filters import filter_logs, filter_spans, page_size
from .skew import lookup

#: Shown for spans whose parents form a cycle.
CYCLE_DEPTH = 65
ENDLESS = 1 << 40


class TraceDetail(NamedTuple):
    summary: DataFrame
    spans: DataFrame


def trace_summary(spans: DataFrame) -> DataFrame:
    """One row per trace. The root is the span that starts first (lowest id on a tie)."""
    first = F.min_by(F.struct("span_name", "service_name"), F.struct("start_ns", "span_id"))
    return (spans.groupBy("trace_id").agg(
        F.min("start_ns").alias("start_ns"), (F.max("end_ns") - F.min("start_ns")).alias("duration_ns"),
        F.count(F.lit(1)).alias("span_count"), F.count_if(F.col("status_code") == 2).alias("error_count"),
        first.alias("_first"), F.array_sort(F.collect_set("service_name")).alias("services"))
        .select("trace_id", "start_ns", "duration_ns", "span_count", "error_count",
                F.col("_first.span_name").alias("root_name"), F.col("_first.service_name").alias("service"),
                "services"))


def matching_traces(spans: DataFrame, errors_only: bool = False, whole_trace: bool = False, **filters) -> DataFrame:
    """Summaries over the spans that match the filters.

    ``whole_trace=True`` summarises all spans of the traces that have a match.
    """
    kept = filter_spans(spans, **filters)
    if whole_trace:
        kept = lookup(spans, kept.select("trace_id").distinct(), ["trace_id"], "inner")
    out = trace_summary(kept)
    return out.where(F.col("error_count") > 0) if errors_only else out


def traces_list(spans: DataFrame, limit: int | None = None, offset: int | None = None, **filters) -> DataFrame:
    """A page of trace summaries, newest first, with the ``total`` of all pages."""
    found = matching_traces(spans, **filters)
    page = (found.orderBy(F.desc("start_ns"), "trace_id")
            .offset(max(offset or 0, 0)).limit(page_size(limit, 100)))
    return page.withColumn("total", trace_total(found).scalar())


def trace_total(traces: DataFrame) -> DataFrame:
    return traces.agg(F.count(F.lit(1)).alias("total"))


def trace_detail(spans: DataFrame, trace_id: str | Column) -> TraceDetail:
    """Summary and ordered spans of one trace; both are empty when it is unknown."""
    own = spans.where(F.col("trace_id") == trace_id)
    return TraceDetail(trace_summary(own), own.orderBy("start_ns", "span_id"))


def logs_of_trace(logs: DataFrame, trace_id: str | Column, span_id: str | Column | None = None) -> DataFrame:
    return filter_logs(logs, trace_id=trace_id, span_id=span_id)


def logs_with_spans(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every log record with the name, service and status of its span, if it has one."""
    named = (spans.groupBy("trace_id", "span_id").agg(
        F.min_by(F.struct("span_name", F.col("service_name").alias("span_service"), "status_code"),
                 F.struct("start_ns", "end_ns", "span_name", "service_name")).alias("_s"))
        .select("trace_id", "span_id", "_s.span_name", "_s.span_service", "_s.status_code"))
    return lookup(logs, named, ["trace_id", "span_id"])


def with_parents(spans: DataFrame) -> DataFrame:
    """Every span with its parent's name and service; ``is_root`` when there is no such parent."""
    parents = (_by_id(spans, ["span_name", "service_name"])
               .select("trace_id", F.col("span_id").alias("parent_span_id"),
                       F.col("_v.span_name").alias("parent_name"), F.col("_v.service_name").alias("parent_service")))
    joined = lookup(spans, parents, ["trace_id", "parent_span_id"])
    return joined.withColumn("is_root", F.col("parent_name").isNull())


def _by_id(spans: DataFrame, columns: list[str]) -> DataFrame:
    """One row per span id; of spans that share an id the last to start counts."""
    return spans.groupBy("trace_id", "span_id").agg(
        F.max_by(F.struct(*columns), F.struct("start_ns", "end_ns", *columns)).alias("_v"))


def span_depths(spans: DataFrame, cycle_depth: int = CYCLE_DEPTH) -> DataFrame:
    """Number of ancestors of every span id.

    A parent that is not in the trace counts as none. A span in or below a cycle
    of parents has no end of ancestors and gets ``cycle_depth``: it is one that has
    taken as many steps up as its trace has spans. Each round lets a span skip to
    its ancestor's ancestor, so the number of joins is the logarithm of the depth.
    Finished spans are written once; only open ones are joined again.
    """
    start = _by_id(spans, ["parent_span_id"]).select(
        "trace_id", "span_id", F.nullif(F.col("_v.parent_span_id"), F.lit("")).alias("up"), F.lit(0).cast("bigint").alias("steps"))
    sizes = start.groupBy("trace_id").agg(F.count(F.lit(1)).alias("most"))
    open_rows = F.count_if(F.col("up").isNotNull())
    state, seen = materialise(lookup(start, sizes, ["trace_id"]), "depth", open=open_rows)
    done = [state.where(F.col("up").isNull())]
    while seen["open"]:
        known = state if len(done) == 1 else reduce(DataFrame.unionByName, [*done, state.where(F.col("up").isNotNull())])
        target = known.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next_up"),
                              F.col("steps").alias("more"), F.lit(True).alias("seen"))
        moved = lookup(state.where(F.col("up").isNotNull()), target, ["trace_id", "up"])
        steps = F.when(F.col("seen"), F.col("steps") + 1 + F.col("more")).otherwise(F.col("steps"))
        moved = moved.select("trace_id", "span_id", F.col("next_up").alias("up"), steps.alias("steps"), "most")
        endless = F.col("up").isNotNull() & (F.col("steps") >= F.col("most"))
        moved = moved.select("trace_id", "span_id", F.when(~endless, F.col("up")).alias("up"),
                             F.when(endless, F.lit(ENDLESS)).otherwise(F.col("steps")).alias("steps"), "most")
        state, seen = materialise(moved, "depth", open=open_rows)
        done.append(state.where(F.col("up").isNull()))
    depth = F.when(F.col("steps") >= ENDLESS, F.lit(cycle_depth)).otherwise(F.col("steps")).cast("bigint")
    return reduce(DataFrame.unionByName, done).select("trace_id", "span_id", depth.alias("depth"))


def waterfall(spans: DataFrame) -> DataFrame:
    """Depth, left edge and width (percent of the trace, width at least 0.5) of every span."""
    extent = spans.groupBy("trace_id").agg(
        F.min("start_ns").alias("trace_start_ns"), F.max("end_ns").alias("_end"))
    extent = extent.select("trace_id", "trace_start_ns", F.greatest(
        F.col("_end") - F.col("trace_start_ns"), F.lit(1)).alias("trace_ns"))
    above = span_depths(spans, ENDLESS).select(
        "trace_id", F.col("span_id").alias("_up"), F.when(F.col("depth") < ENDLESS, F.col("depth") + 1).otherwise(CYCLE_DEPTH).alias("_depth"))
    placed = spans.select("trace_id", "span_id", "parent_span_id", "span_name", "service_name", "start_ns", "end_ns",
                          F.nullif("parent_span_id", F.lit("")).alias("_up"))
    # Spans that share an id each follow their own parent.
    placed = lookup(placed, above, ["trace_id", "_up"])
    placed = placed.withColumn("depth", F.coalesce("_depth", F.lit(0)).cast("bigint"))
    placed = lookup(placed.drop("_up", "_depth"), extent, ["trace_id"])
    total = F.col("trace_ns").cast("double")
    left = (F.col("start_ns") - F.col("trace_start_ns")) / total * 100.0
    width = (F.col("end_ns") - F.col("start_ns")) / total * 100.0
    return placed.withColumns({"left_pct": left, "width_pct": F.greatest(width, F.lit(0.5))})
