"""What each file of a batch holds: membership filters for ids, trigram bitmaps for text, sketches for distinct counts.

Written next to a batch, in two small tables. ``facts`` has one row per data
file: rows, time range, size, the width of each filter and HyperLogLog sketches.
``bits`` has the filters themselves, one row per file, field and word of 64 bits
that is not zero, sorted by field and word: a lookup reads the words it asks for
and no others.

An id sets ``PROBES`` bits of a filter (a Bloom filter) whose width, a power of
two, follows from the file's number of ids. A text sets one bit for each
trigram, in lower case, in a bitmap of ``TRIGRAM_BITS``. Neither ever misses a
file that holds what is asked for; some files are read in vain.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import TIME_COLUMN

PROBES = 5
BITS_PER_ID = 10  # about one file in a hundred is read in vain
TRIGRAM_BITS = 1 << 16
IDS = {"spans": ("trace_id", "span_id"), "log_records": ("trace_id", "span_id"), "metric_points": ()}
#: Columns that a search looks at; a file has one bitmap for all of them, under this field.
SEARCHED = {"spans": ("span_name", "trace_id"), "log_records": ("body", "log_attributes", "severity_text", "event_name"),
            "metric_points": ("metric_name", "metric_description")}
TEXT = "*"
#: Columns whose distinct values are sketched.
SKETCHED = {"spans": ("service_name", "trace_id"), "log_records": ("service_name",), "metric_points": ("service_name", "metric_name")}

FACTS = ("folder string, file string, event_date date, rows bigint, bytes bigint, first_ns bigint, last_ns bigint, "
         "widths map<string, bigint>, sketches map<string, binary>")
BITS = "field string, word bigint, folder string, file string, bits bigint"


def id_places(value: Column, width: Column) -> Column:
    """The places of an id in a filter of this width."""
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(k)), width) for k in range(PROBES)])


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters, in lower case."""
    chars = F.split(F.lower(text), "")
    three = F.zip_with(F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars), F.lit(0))), lambda a, b: F.concat(a, b)),
                       F.slice(chars, 3, F.greatest(F.size(chars), F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(three, lambda t: t.isNotNull()))


def trigram_places(text: Column) -> Column:
    return F.transform(trigrams(text), lambda t: F.pmod(F.xxhash64(t), F.lit(TRIGRAM_BITS).cast("bigint")))


def build(batch: DataFrame, table: str, folder: str, path: str) -> None:
    """Writes ``facts`` and ``bits`` of a batch that has been read from its files; two passes over the indexed columns."""
    file = F.substring_index(F.col("_metadata.file_path"), "/", -2)  # below the batch's folder: the day, the file
    end = "end_ns" if table == "spans" else TIME_COLUMN[table]
    rows = batch.select(file.alias("file"), F.col("_metadata.file_size").alias("_bytes"), "event_date", F.col(TIME_COLUMN[table]).alias("_from"),
                        F.col(end).alias("_to"), *dict.fromkeys(IDS[table] + SEARCHED[table] + SKETCHED[table]))
    widths = [F.struct(F.lit(c).alias("key"), F.pow(F.lit(2.0), F.ceil(F.log2(
        F.greatest(F.approx_count_distinct(c) * BITS_PER_ID, F.lit(1024))))).cast("bigint").alias("value")) for c in IDS[table]]
    widths.append(F.struct(F.lit(TEXT).alias("key"), F.lit(TRIGRAM_BITS).cast("bigint").alias("value")))
    sketches = [F.struct(F.lit(c).alias("key"), F.hll_sketch_agg(c).alias("value")) for c in SKETCHED[table]]
    facts = rows.groupBy("file").agg(
        F.first("event_date").alias("event_date"), F.count(F.lit(1)).alias("rows"), F.first("_bytes").alias("bytes"),
        F.min("_from").alias("first_ns"), F.max("_to").alias("last_ns"), F.map_from_entries(F.array(*widths)).alias("widths"),
        F.map_from_entries(F.array(*sketches)).alias("sketches"))
    facts = facts.select(F.lit(folder).alias("folder"), *[c for c in facts.columns])
    facts.write.mode("overwrite").parquet(f"{path}/facts")
    spark = batch.sparkSession
    known = spark.read.schema(FACTS).parquet(f"{path}/facts").select("file", "widths")
    places = rows.join(known, "file")
    fields = [F.struct(F.lit(c).alias("field"), F.when(F.col(c) != "", id_places(F.col(c), F.col("widths")[c])).alias("places")) for c in IDS[table]]
    fields += [F.struct(F.lit(TEXT).alias("field"), trigram_places(F.col(c)).alias("places")) for c in SEARCHED[table]]
    bits = (places.select("file", F.inline(F.array(*fields))).select("file", "field", F.explode("places").alias("place"))
            .groupBy("file", "field", F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")))
    bits = bits.select("field", "word", F.lit(folder).alias("folder"), "file", "bits")
    bits.repartitionByRange("field", "word", "file").sortWithinPartitions("field", "word").write.mode("overwrite").parquet(f"{path}/bits")


def fragments(q: str) -> list[str]:
    """The parts of a ``contains`` pattern that have to stand in the text as they are."""
    return [p for p in re.split("[%_]", q) if len(p) > 2]


def candidates(spark: SparkSession, indexes: list[str], ids: dict[str, str] | None = None,
               q: str | None = None) -> list[tuple[str, str]] | None:
    """``(folder, file)`` of the files that may hold these ids and this text; None where nothing is asked that an index knows."""
    asked = [(k, v, False) for k, v in (ids or {}).items() if v] + [(TEXT, p, True) for p in fragments(q or "")]
    if not asked or not indexes:
        return None
    facts = spark.read.schema(FACTS).parquet(*[f"{p}/facts" for p in indexes])
    widths = facts.select(F.explode("widths").alias("field", "width")).distinct()  # powers of two: a few dozen rows
    wanted = spark.createDataFrame(asked, "field string, value string, is_text boolean")
    places = F.when(F.col("is_text"), trigram_places(F.col("value"))).otherwise(id_places(F.col("value"), F.col("width")))
    probes = (widths.join(wanted, "field").select("field", "width", F.explode(places).alias("place"))
              .groupBy("field", "width", F.shiftright("place", 6).alias("word"))
              .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("mask")).collect())
    if not probes:
        return None
    words = sorted({r["word"] for r in probes})
    bits = (spark.read.schema(BITS).parquet(*[f"{p}/bits" for p in indexes])
            .where(F.col("field").isin(sorted({r["field"] for r in probes})) & F.col("word").isin(words)))
    probe_rows = spark.createDataFrame([tuple(r) for r in probes], "field string, width bigint, word bigint, mask bigint")
    each = facts.select("folder", "file", F.explode("widths").alias("field", "width"))
    needed = each.join(probe_rows, ["field", "width"])
    held = needed.join(bits, ["folder", "file", "field", "word"], "left").where(
        F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) != F.col("mask"), F.lit(True)))
    missing = held.select("folder", "file").distinct()
    return [tuple(r) for r in facts.select("folder", "file").join(missing, ["folder", "file"], "left_anti").collect()]
