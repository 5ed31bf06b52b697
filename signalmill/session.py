"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

RECOMMENDED = {
    # Re-plan joins and partition counts from what the shuffles really produced.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Walking the Python stack for every column call makes building a plan slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Trace summaries hold sets and structs; without this they fall back to sorting
    # after 128 traces per task.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    # A deep page is sorted by range over the cluster instead of being kept
    # whole in one task.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def build_session(master: str | None = None, app: str = "signalmill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read and write.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local
    folder is made for a local master only, which has one machine; else it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="signalmill-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/signalmill/{label}-{uuid.uuid4().hex}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage."""
    was = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, was)


def materialise(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage of iterative operators; the files outlive any executor, and
    the shuffles that led to them are removed. ``counts`` are aggregates taken from the rows while they are written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    observed = df.observe(seen, *[c.alias(name) for name, c in counts.items()]) if counts else df
    with passing_shuffles(spark):
        observed.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), (seen.get if counts else {})


def widen(df: DataFrame) -> DataFrame:
    """Spreads an input of fewer partitions than cores, such as one small file; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
