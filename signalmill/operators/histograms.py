"""Percentiles and heatmaps from histogram snapshots.

The latest snapshot per time bucket is picked by a partial aggregate; all work
on bounds and counts is done on that row's arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsontext import double_array
from ..functions.numbers import round_to
from ..functions.timeutil import HALF_MINUTE, bucket_ts, is_finite
from .counters import observed, point_order

INF = float("inf")


def latest_per_bucket(points: DataFrame, width_ns: int, columns: list[str],
                      series_keys: tuple[str, ...] = ()) -> DataFrame:
    """The last point of every time bucket (and series, if keys are given)."""
    newest = F.max_by(F.struct(*columns), F.struct(*point_order(), "series_attributes"))
    return (points.groupBy(bucket_ts(F.col("ts_ns"), width_ns).alias("ts"), *series_keys)
            .agg(newest.alias("_p")).select("ts", *series_keys, "_p.*"))


def _snapshots(points: DataFrame, metric: str, width_ns: int, where: dict,
               series_keys: tuple[str, ...] = ()) -> DataFrame:
    last = latest_per_bucket(observed(points, metric, **where), width_ns,
                             ["hist_bounds", "hist_bucket_counts"], series_keys)
    return last.select("ts", *series_keys, double_array(F.col("hist_bounds")).alias("bounds"),
                       double_array(F.col("hist_bucket_counts")).alias("counts"))


def _or_empty(xs: Column) -> Column:
    return F.coalesce(xs, F.array().cast("array<double>"))


def finite_bounds(bounds: Column) -> Column:
    return F.filter(_or_empty(bounds), is_finite)


def bucket_cells(bounds: Column, counts: Column) -> Column:
    """``{bound, c}`` per bucket; lists of unlike length are padded with NULL."""
    return F.arrays_zip(bounds.alias("bound"), counts.alias("c"))


def _running(cells: Column) -> Column:
    """``{bound, cum}`` in bound order with the running count."""
    ordered = F.array_sort(cells, lambda a, b: F.when(a["bound"].isNull() & b["bound"].isNull(), 0)
                           .when(a["bound"].isNull(), 1).when(b["bound"].isNull(), -1)
                           .when(a["bound"] < b["bound"], -1).when(a["bound"] > b["bound"], 1).otherwise(0))

    def add(done: Column, x: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["cum"], F.lit(0.0))
        cum = before + F.coalesce(x["c"], F.lit(0.0))
        return F.array_append(done, F.struct(x["bound"].alias("bound"), cum.alias("cum")))

    return F.aggregate(ordered, F.array().cast("array<struct<bound:double,cum:double>>"), add)


def histogram_percentiles(points: DataFrame, metric: str, width_ns: int = HALF_MINUTE,
                          qs: tuple[float, ...] = (0.5, 0.95, 0.99), names: tuple[str, ...] | None = None,
                          finite_only: bool = True, series_keys: tuple[str, ...] = (), **where) -> DataFrame:
    """Bucket bounds at the given shares of the latest snapshot per time bucket.

    The result is the smallest bound whose running count reaches the share. With
    ``finite_only`` mass in the open bucket gives the largest finite bound;
    without it the result is infinite.
    """
    snaps = _snapshots(points, metric, width_ns, where, series_keys)
    finite = finite_bounds(F.col("bounds"))
    listed = finite if finite_only else _or_empty(F.col("bounds"))
    cells = bucket_cells(F.array_append(listed, F.lit(INF)), _or_empty(F.col("counts")))
    total = F.aggregate(F.col("counts"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    run = (snaps.withColumns({"_cells": cells, "_n": F.when(F.size("counts") > 0, total), "_top": F.array_max(finite)})
           .withColumn("_run", _running(F.col("_cells"))))
    out = []
    for q, name in zip(qs, names or tuple(f"p{round(q * 100)}" for q in qs)):
        reached = F.filter(F.col("_run"), lambda x: (x["cum"] >= q * F.col("_n")) & (
            is_finite(x["bound"]) if finite_only else x["bound"].isNotNull()))
        at = F.array_min(F.transform(reached, lambda x: x["bound"]))
        value = F.coalesce(_round_bound(at), _round_bound(F.col("_top"))) if finite_only else _round_bound(at)
        out.append(value.alias(name))
    return run.select("ts", *series_keys, *out).orderBy("ts", *series_keys)


def _round_bound(x: Column) -> Column:
    return F.when(is_finite(x), round_to(x, 3)).otherwise(x)


def latency_heatmap(points: DataFrame, metric: str, width_ns: int = HALF_MINUTE, **where) -> DataFrame:
    """``(ts, y, weight)``: count per bucket of the latest snapshot, y its lower edge."""
    snaps = _snapshots(points, metric, width_ns, where)
    edges = F.array_prepend(finite_bounds(F.col("bounds")), F.lit(0.0))
    cells = F.arrays_zip(edges.alias("y"), _or_empty(F.col("counts")).alias("weight"))
    return (snaps.select("ts", F.inline(cells).alias("y", "weight"))
            .where(F.col("weight").isNotNull() & F.col("y").isNotNull()).orderBy("ts", "y"))


def histogram_mean(hist_sum: Column, hist_count: Column) -> Column:
    return F.try_divide(hist_sum, hist_count)
