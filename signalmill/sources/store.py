"""The signal tables on Parquet: a folder per batch, partitioned by UTC day in it. Batch jobs and streams write alike.

A batch counts once the manifest lists it (``manifest``). Each batch comes with
an index of its files (``fileindex``), by which lookups choose what to read.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.jsontext import attribute
from ..functions.timeutil import event_date
from ..operators.filters import promoted_name
from ..schemas import TABLES, TIME_COLUMN
from . import fileindex, manifest
from .manifest import Entry

Promoted = tuple[tuple[str, str], ...]


def with_layout(df: DataFrame, table: str, promote: Promoted = ()) -> DataFrame:
    """Adds the partition column and one text column per promoted ``(json column, key)``.

    A filter on a promoted attribute reads that column alone and uses its file
    statistics; a filter on JSON text has to parse every row.
    """
    extra = {promoted_name(c, k): attribute(F.col(c), k) for c, k in promote}
    return df.withColumns({**extra, "event_date": event_date(F.col(TIME_COLUMN[table]))})


def table_schema(table: str, promote: Promoted = ()) -> T.StructType:
    extra = [T.StructField(promoted_name(c, k), T.StringType()) for c, k in promote]
    fields = [T.StructField(f.name, f.dataType, True) for f in TABLES[table].fields]
    return T.StructType([*fields, *extra, T.StructField("event_date", T.DateType())])


def append(df: DataFrame, root: str, table: str, promote: Promoted = (), balance: bool = True,
           batch: str | None = None) -> None:
    """Appends a batch of one table; see ``append_all``."""
    append_all({table: df}, root, {table: promote}, balance, batch)


def append_all(frames: dict[str, DataFrame], root: str, promote: dict[str, Promoted] | None = None, balance: bool = True,
               batch: str | None = None) -> None:
    """Appends a batch of several tables, which readers see whole or not at all.

    Every table's rows go to a new folder, with an index of its files; one new
    manifest then lists them all. A batch written again under the same name
    replaces itself, table by table; where it has been compacted meanwhile, it is
    known to be there and nothing is added.

    ``balance`` spreads a large day over several files and keeps small days in
    one, and sorts each file so that row groups can be skipped by service and time.
    """
    name = batch or f"b-{uuid.uuid4().hex}x"
    spark = next(iter(frames.values())).sparkSession
    _begin(spark, root)
    fresh = [_write(df, root, table, name, (promote or {}).get(table, ()), balance) for table, df in frames.items()]

    def change(entries: list[Entry]) -> list[Entry]:
        new = [e for e in fresh if not any(x.table == e.table and x.stands_for(name) for x in entries)]
        return [x for x in entries if not any(x.table == e.table and x.batch == e.batch for e in new)] + new

    manifest.commit(spark, root, change)


def _begin(spark: SparkSession, root: str) -> None:
    """A first manifest, before anything is written, with the batches of a store from before it had manifests."""
    if manifest.snapshot(spark, root) is None:
        manifest.commit(spark, root, lambda entries: entries, lambda: _adopted(spark, root))


def _write(df: DataFrame, root: str, table: str, name: str, promote: Promoted, balance: bool, laid_out: bool = False) -> Entry:
    out = df if laid_out else with_layout(df, table, promote)
    if balance:
        out = out.hint("rebalance", "event_date").sortWithinPartitions("event_date", "service_name", TIME_COLUMN[table])
    folder = f"batch={name}.{uuid.uuid4().hex[:12]}"
    seen = Observation()
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("event_date").parquet(f"{root}/{table}/{folder}")
    rows, index = seen.get["n"], None
    if rows:
        index = f"_index/{table}/{folder}"
        batch = df.sparkSession.read.schema(table_schema(table, promote)).parquet(f"{root}/{table}/{folder}")
        fileindex.build(batch, table, f"{table}/{folder}", f"{root}/{index}")
    return Entry(table, name, f"{table}/{folder}", index, rows)


def _adopted(spark: SparkSession, root: str) -> list[Entry]:
    """Batches of a store from before it had manifests."""
    files = manifest.Files(spark, root)
    return [Entry(table, name.removeprefix("batch="), f"{table}/{name}") for table in TABLES
            for name, _ in files.names(table) if name.startswith("batch=") and files.names(f"{table}/{name}")
            and any(n == "_SUCCESS" for n, _ in files.names(f"{table}/{name}"))]


def entries_of(spark: SparkSession, root: str, table: str) -> list[Entry]:
    now = manifest.snapshot(spark, root)
    return now.of(table) if now else [e for e in _adopted(spark, root) if e.table == table]


def _read(spark: SparkSession, root: str, table: str, promote: Promoted, paths: list[str]) -> DataFrame:
    schema = table_schema(table, promote)
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(*[f"{root}/{p}" for p in paths]).drop("batch")


def read_table(spark: SparkSession, root: str, table: str, promote: Promoted = ()) -> DataFrame:
    """The committed batches of a table, as of now."""
    return _read(spark, root, table, promote, [e.path for e in entries_of(spark, root, table) if e.rows != 0])


def read_matching(spark: SparkSession, root: str, table: str, ids: dict[str, str] | None = None, q: str | None = None,
                  promote: Promoted = ()) -> DataFrame:
    """The files of a table that may hold rows with these ids, and with the text ``q`` of a search.

    Which files these are is read from the indexes when the frame is made; the rows are not filtered. Batches without an index
    are read whole.
    """
    entries = [e for e in entries_of(spark, root, table) if e.rows != 0]
    found = fileindex.candidates(spark, [f"{root}/{e.index}" for e in entries if e.index], ids, q)
    if found is None:
        return _read(spark, root, table, promote, [e.path for e in entries])
    return _read(spark, root, table, promote, [f"{folder}/{file}" for folder, file in sorted(found)] + [e.path for e in entries if not e.index])


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, root, t) for t in TABLES}


def file_facts(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One row per indexed file: rows, bytes, time range, sketches."""
    paths = [f"{root}/{e.index}/facts" for e in entries_of(spark, root, table) if e.index]
    return spark.read.schema(fileindex.FACTS).parquet(*paths) if paths else spark.createDataFrame([], fileindex.FACTS)


def reset(spark: SparkSession, root: str) -> None:
    """Empties the three tables at once, by a manifest without batches. ``vacuum`` removes the files."""
    manifest.commit(spark, root, lambda entries: [])


def compact(spark: SparkSession, root: str, table: str, promote: Promoted = (), least: int = 2) -> int:
    """Folds the batches of a table into one, rows unchanged; gives the number of batches folded.

    Readers that have begun go on with the old folders, which stay until
    ``vacuum``. Where one of the batches is replaced or reset meanwhile, the
    compaction gives way.
    """
    _begin(spark, root)
    old = entries_of(spark, root, table)
    if len(old) < least:
        return 0
    rows = _read(spark, root, table, promote, [e.path for e in old if e.rows != 0])
    made = _write(rows, root, table, f"c-{uuid.uuid4().hex}x", promote, True, laid_out=True)
    folded, names = manifest.fold_names(old)
    made = replace(made, folded=folded, names=names)

    def change(entries: list[Entry]) -> list[Entry] | None:
        return [e for e in entries if e not in old] + [made] if all(e in entries for e in old) else None

    after = manifest.commit(spark, root, change)
    return len(old) if made in after.entries else 0


def vacuum(spark: SparkSession, root: str, older_than_s: float = 7 * 86400) -> list[str]:
    """Removes what no batch uses any more; see ``manifest.vacuum``."""
    return manifest.vacuum(spark, root, TABLES, older_than_s)
