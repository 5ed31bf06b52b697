"""What the store holds: services, counts, columns, column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..schemas import SQL_TYPE_NAMES, TIME_COLUMN
from .filters import attribute_column

_ATTRIBUTES = {"spans": "span_attributes", "log_records": "log_attributes", "metric_points": "series_attributes"}
_COUNTS = {"spans": "span_count", "log_records": "log_count", "metric_points": "point_count"}


def _end_column(table: str) -> str:
    return "end_ns" if table == "spans" else TIME_COLUMN[table]


def service_rollup(tables: dict[str, DataFrame]) -> DataFrame:
    """First and last time and the counts of all three signals per service."""
    parts = []
    for table, counted in _COUNTS.items():
        grouped = tables[table].groupBy("service_name").agg(
            F.min(TIME_COLUMN[table]).alias("first_ns"), F.max(_end_column(table)).alias("last_ns"),
            F.count(F.lit(1)).alias("n"))
        parts.append(grouped.select("service_name", "first_ns", "last_ns", *[
            (F.col("n") if c == counted else F.lit(0).cast("bigint")).alias(c) for c in _COUNTS.values()]))
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (merged.groupBy("service_name").agg(
        F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"),
        *[F.sum(c).alias(c) for c in _COUNTS.values()]).orderBy("service_name"))


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of totals over all signals: one aggregate per table, merged from three rows."""
    zero = F.lit(0).cast("bigint")
    totals = ("spans", "traces", "logs", "metric_points", "metrics", "services")

    def part(df: DataFrame, *time: str, **figures) -> DataFrame:
        low, high = (F.min(time[0]), F.max(time[1])) if time else (F.lit(None).cast("bigint"),) * 2
        one = df.agg(low.alias("lo"), high.alias("hi"), *[f.alias("_" + name) for name, f in figures.items()])
        return one.select(*[(F.col("_" + c) if c in figures else zero).alias(c) for c in totals], "lo", "hi")

    n = F.count(F.lit(1))
    rows = (part(tables["spans"], "start_ns", "end_ns", spans=n, traces=F.count_distinct("trace_id"))
            .unionByName(part(tables["log_records"], "time_ns", "time_ns", logs=n))
            .unionByName(part(tables["metric_points"], "ts_ns", "ts_ns", metric_points=n, metrics=F.count_distinct("metric_name")))
            .unionByName(part(services(tables), services=n)))
    return rows.agg(*[F.sum(c).alias(c) for c in totals], F.min("lo").alias("earliest_ns"), F.max("hi").alias("latest_ns"))


def services(tables: dict[str, DataFrame]) -> DataFrame:
    """The set of service names over all signals."""
    names = [tables[t].select("service_name") for t in _COUNTS]
    return names[0].union(names[1]).union(names[2]).distinct()


def schema_listing(tables: dict[str, DataFrame]) -> DataFrame:
    """Table, position, column, type and row count."""
    parts = []
    for table in sorted(tables):
        df = tables[table]
        columns = F.array(*[F.struct(
            F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
            F.lit(SQL_TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper())).alias("data_type"))
            for i, f in enumerate(df.schema.fields)])
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(counted.select(F.lit(table).alias("table_name"), "row_count", F.inline(columns)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("table_name", "ordinal")


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, files and bytes per table; sizes need tables read from files."""
    parts = []
    for table in sorted(tables):
        df = tables[table]
        files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("bytes"))
        parts.append(files.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("estimated_size"), F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"))
            .select(F.lit(table).alias("table_name"), "estimated_size",
                    F.lit(len(df.columns)).alias("column_count"), "files", "size_bytes"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("table_name")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: least, largest, approximate distinct count, mean, share of NULL.

    All figures come from one aggregate over the table.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("n")], []
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        numeric = isinstance(field.dataType, T.NumericType)
        aggregates += [
            F.min(c).cast("string").alias(f"min{i}"), F.max(c).cast("string").alias(f"max{i}"),
            F.approx_count_distinct(c).alias(f"distinct{i}"), F.count(c).alias(f"count{i}"),
            (F.avg(c).cast("double") if numeric else F.lit(None).cast("double")).alias(f"avg{i}")]
        rows.append(F.struct(
            F.lit(i + 1).alias("ordinal"), F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("column_type"), F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"), F.col(f"distinct{i}").alias("approx_unique"), F.col(f"avg{i}").alias("avg"),
            F.col("n").alias("count"), (F.col("n") - F.col(f"count{i}")).alias("null_count"),
            F.try_divide((F.col("n") - F.col(f"count{i}")) * 100.0, F.col("n")).alias("null_percentage")))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def summarize(df: DataFrame, accuracy: int = 100_000) -> DataFrame:
    """One row per column, all from one aggregate: least, largest, distinct count, mean, deviation, quartiles, rows, share of NULL.

    Quartiles are values of the column, from sketches that add up over partitions: their rank is off by at most a share of
    ``1 / accuracy`` of the rows; those of whole numbers beyond 2^53 are rounded as doubles are. The distinct count is off by five percent (standard error). Mean and deviation of whole numbers
    are taken from exact sums. NaN counts as a number above all others, as it sorts.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("n")], []
    for i, field in enumerate(df.schema.fields):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        numeric = isinstance(kind, T.NumericType)
        plain = not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        none = F.lit(None).cast("double")
        mean = F.avg(c.cast("decimal(38,6)")).cast("double") if isinstance(kind, T.IntegralType) else F.avg(c).cast("double") if numeric else none
        aggregates += [
            (F.min(c).cast("string") if plain else F.lit(None).cast("string")).alias(f"min{i}"),
            (F.max(c).cast("string") if plain else F.lit(None).cast("string")).alias(f"max{i}"),
            (F.approx_count_distinct(c) if plain else F.lit(None).cast("bigint")).alias(f"distinct{i}"), F.count(c).alias(f"count{i}"),
            mean.alias(f"avg{i}"), (F.stddev_samp(c) if numeric else none).alias(f"std{i}"),
            (F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy).cast("array<string>") if numeric
             else F.lit(None).cast("array<string>")).alias(f"q{i}")]
        rows.append(F.struct(
            F.lit(i + 1).alias("ordinal"), F.lit(field.name).alias("column_name"), F.lit(kind.simpleString()).alias("column_type"),
            F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.col(f"distinct{i}").alias("approx_unique"),
            F.col(f"avg{i}").alias("avg"), F.col(f"std{i}").alias("std"), *[F.col(f"q{i}")[k].alias(q) for k, q in enumerate(("q25", "q50", "q75"))],
            F.col("n").alias("count"), F.try_divide((F.col("n") - F.col(f"count{i}")) * 100.0, F.col("n")).alias("null_percentage")))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def attribute_options(tables: dict[str, DataFrame], table: str, key: str, resource: bool = False) -> DataFrame:
    """Sorted distinct non-empty values of an attribute, for an input's drop-down list."""
    column = "resource_attributes" if resource else _ATTRIBUTES[table]
    df = tables[table].where(F.col(column).isNotNull())
    values = df.select(attribute_column(df, column, key).alias("v")).distinct()
    return values.where(F.col("v").isNotNull() & ~F.col("v").isin("", "null")).orderBy("v")
