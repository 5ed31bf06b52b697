"""Streaming versions of span rates, counter increases, trace summaries and totals.

Results that change while they grow are written as versions: every micro-batch
adds a folder with the rows it changed, and ``latest`` keeps the newest version
of each key. A manifest lists the folders, so readers see a micro-batch whole or
not at all; a repeated one replaces its own folder, so a restart leaves no
duplicates. ``fold`` leaves one folder with the newest versions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timeutil import HALF_MINUTE, NS_PER_S, ns_to_timestamp
from ..operators.counters import SERIES, counter_increase, point_order
from ..operators.red import error_share_column, rate_column
from ..sources import manifest
from ..sources.manifest import Entry

BATCH = "batch_id"


VERSIONS = "versions"


def write_versions(changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                   mode: str = "update") -> StreamingQuery:
    def save(batch: DataFrame, batch_id: int) -> None:
        put_version(batch, path, batch_id)

    return (changes.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _write_version(rows: DataFrame, path: str, batch_id: int) -> str:
    folder = f"{VERSIONS}/{BATCH}={batch_id}/attempt={uuid.uuid4().hex[:12]}"
    rows.write.mode("overwrite").parquet(f"{path}/{folder}")
    return folder


def put_version(rows: DataFrame, path: str, batch_id: int) -> None:
    """Adds the rows that a micro-batch changed, or puts them in place of what it wrote before."""
    name = f"v-{batch_id}"
    fresh = Entry(VERSIONS, name, _write_version(rows, path, batch_id))

    def change(entries: list[Entry]) -> list[Entry] | None:
        if any(e.stands_for(name) for e in entries):
            return None  # folded already
        return [e for e in entries if e.batch != name] + [fresh]

    manifest.commit(rows.sparkSession, path, change)


def _versions(spark: SparkSession, path: str, entries: list[Entry]) -> DataFrame:
    read = spark.read.option("basePath", f"{path}/{VERSIONS}").parquet(*[f"{path}/{e.path}" for e in entries])
    return read.drop("attempt").withColumn(BATCH, F.col(BATCH).cast("bigint"))


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_v"))
    return newest.select(*keys, "_v.*")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every key, as of now."""
    now = manifest.snapshot(spark, path)
    if now is None or not now.entries:
        raise ValueError(f"no micro-batch has been committed below {path}")
    return _newest(_versions(spark, path, list(now.entries)), keys)


def all_versions(spark: SparkSession, path: str) -> DataFrame:
    """Every row that was written, with the number of its micro-batch."""
    now = manifest.snapshot(spark, path)
    return _versions(spark, path, list(now.entries) if now else [])


def fold(spark: SparkSession, path: str, keys: list[str], least: int = 2) -> int:
    """Folds all versions into one folder with the newest of each key; gives the number of folders folded.

    Readers that have begun keep the old folders until ``manifest.vacuum``; where the stream replaces one of them meanwhile, the
    folding gives way.
    """
    now = manifest.snapshot(spark, path)
    old = list(now.entries) if now else []
    if len(old) < least:
        return 0
    folded, names = manifest.fold_names(old)
    newest = max(int(e.path.split("/")[1].removeprefix(f"{BATCH}=")) for e in old)
    made = Entry(VERSIONS, f"c-{uuid.uuid4().hex}x", _write_version(_newest(_versions(spark, path, old), keys), path, newest),
                 folded=folded, names=names)

    def change(entries: list[Entry]) -> list[Entry] | None:
        return [e for e in entries if e not in old] + [made] if all(e in entries for e in old) else None

    return len(old) if made in manifest.commit(spark, path, change).entries else 0


def span_red(spans: DataFrame, width_ns: int = HALF_MINUTE, late: str = "10 minutes") -> DataFrame:
    """Rate and error share per tumbling window; spans later than ``late`` are dropped."""
    timed = spans.withColumn("_at", ns_to_timestamp(F.col("start_ns"))).withWatermark("_at", late)
    window = F.window("_at", f"{width_ns // NS_PER_S} seconds")
    return (timed.groupBy(window.alias("w"))
            .agg(rate_column(width_ns).alias("rps"), error_share_column().alias("err_pct"))
            .select(F.col("w.start").alias("ts"), "rps", "err_pct"))


def partial_summaries(spans: DataFrame, keep: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Trace summaries per trace and time window, so that the state of old windows can go.

    ``merge_summaries`` joins the windows of a trace that lies across a border.
    """
    timed = spans.withColumn("_at", ns_to_timestamp(F.col("start_ns"))).withWatermark("_at", late)
    first = F.min_by(F.struct("span_name", "service_name"), F.struct("start_ns", "span_id"))
    return (timed.groupBy("trace_id", F.window("_at", keep).alias("w")).agg(
        F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count(F.lit(1)).alias("span_count"),
        F.count_if(F.col("status_code") == 2).alias("error_count"), F.min(F.struct("start_ns", "span_id")).alias("first_at"),
        first.alias("first"), F.collect_set("service_name").alias("services"))
        .withColumn("window_start", F.col("w.start")).drop("w"))


def merge_summaries(parts: DataFrame) -> DataFrame:
    first = F.min_by("first", "first_at")
    return (parts.groupBy("trace_id").agg(
        F.min("start_ns").alias("start_ns"), (F.max("end_ns") - F.min("start_ns")).alias("duration_ns"),
        F.sum("span_count").alias("span_count"), F.sum("error_count").alias("error_count"), first.alias("_first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("services")))).alias("services"))
        .select("trace_id", "start_ns", "duration_ns", "span_count", "error_count",
                F.col("_first.span_name").alias("root_name"), F.col("_first.service_name").alias("service"), "services"))


def signal_counts(signals: dict[str, DataFrame]) -> DataFrame:
    """Rows per signal; the state is one row per signal."""
    named = [df.select(F.lit(name).alias("signal")) for name, df in signals.items()]
    return reduce(DataFrame.unionByName, named).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


def start_increases(points: DataFrame, path: str, checkpoint: str, series_keys: tuple[str, ...] = SERIES,
                    values: tuple[str, ...] = ("hist_count",), trigger: dict | None = None) -> StreamingQuery:
    """Continuous ``counter_increase``: every micro-batch writes its points with their increase.

    What one micro-batch hands to the next is a small table, the last point of
    each series. It joins the next batch as that series' first point, so the batch
    operator does the work and a hot series spreads over tasks as it does there.
    Points of a series have to arrive in time order from batch to batch.
    """
    carried = f"{path}/carried"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("_carried", F.lit(False))
        if batch_id > 0:
            before = spark.read.schema(batch.schema).parquet(f"{carried}/{BATCH}={batch_id - 1}")
            fresh = fresh.unionByName(before.withColumn("_carried", F.lit(True)))
        rises = counter_increase(fresh, series_keys, values)
        rises.where(~F.col("_carried")).drop("_carried").write.mode("overwrite").parquet(f"{path}/rows/{BATCH}={batch_id}")
        order = F.struct(*point_order(values))
        last = fresh.groupBy(*series_keys).agg(F.max_by(F.struct(*batch.columns), order).alias("_p")).select("_p.*")
        last.write.mode("overwrite").parquet(f"{carried}/{BATCH}={batch_id}")

    return (points.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
