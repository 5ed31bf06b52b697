"""Log search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .filters import filter_logs, page_size

# Newest first; the rest only makes the order total.
ORDER = (F.desc, "time_ns"), (F.asc_nulls_last, "service_name"), (F.asc_nulls_last, "body"), \
    (F.asc_nulls_last, "trace_id"), (F.asc_nulls_last, "span_id"), (F.asc_nulls_last, "log_attributes")


def log_order():
    return [direction(name) for direction, name in ORDER]


def logs_list(logs: DataFrame, limit: int | None = None, offset: int | None = None, **filters) -> DataFrame:
    """A page of log records, newest first, with the ``total`` of all pages."""
    found = filter_logs(logs, **filters)
    page = found.orderBy(*log_order()).offset(max(offset or 0, 0)).limit(page_size(limit, 100))
    return page.withColumn("total", found.agg(F.count(F.lit(1))).scalar())
