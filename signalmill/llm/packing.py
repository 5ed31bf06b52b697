"""Best-fit packing of token sequences into windows of fixed capacity, in bulk-synchronous rounds.

Documents are tokenised once, in Arrow batches, and cut into pieces of at most
``capacity`` tokens. Pieces are sorted by length over the whole cluster, which
gives each a rank within its length. A round places all pieces of one length,
longest first: it looks for the successor of that length among the open gaps
(the smallest gap that is large enough), hands the ranks out to those gaps in
order, so no two pieces want the same place, updates the gaps and repeats until
no rank is left; what finds no gap opens windows.

Pieces of one length and windows with one gap are alike, so a round works on
*runs* of them (first rank, count). There are at most ``capacity`` lengths and
``capacity`` gaps, whatever the number of documents: the rounds run on these
counts, and their outcome, a list of rank intervals, is joined back to all
pieces. No piece passes through the driver.

Nulls count as the empty text, which is one piece of the end mark alone. Equal
lengths are told apart by document id, checksum and piece number; repeated rows
are packed as often as they occur. An empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalmill.llm.common import bounded_batches, plain, text_of
from signalmill.llm.wordbpe import word_tokens
from signalmill.session import materialise

_PIECES = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"
_KIND = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                            ("ids_crc32", pa.int64())]))


def pieces_of(text: Column, tokenizer_file: str, capacity: int, end_id: int = 0) -> Column:
    """Pieces of each text: the ids followed by ``end_id``, cut after every ``capacity`` tokens."""

    @F.arrow_udf(_PIECES)
    def cut(texts: pa.Array) -> pa.Array:
        end, out = np.array([end_id], "<u4").tobytes(), []
        for t in word_tokens(tokenizer_file).batch(texts):
            ids = t + end
            out.append([{"piece": k, "start": at // 4, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)}
                        for k, at in enumerate(range(0, len(ids), 4 * capacity)) for p in [ids[at:at + 4 * capacity]]])
        return pa.array(out, _KIND)

    return cut(text)


def plan_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds over runs: ``(length, first rank, count, first window, pieces per window, offset)`` for each match.

    Ranks ``first, first + 1, ...`` go to windows ``first_window, ...``, ``per``
    in a row to each, starting at ``offset`` and ``length`` apart.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_sizes: list[int] = []
    plan, windows = [], 0

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                insort(open_sizes, gap)
            gaps.setdefault(gap, []).append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(open_sizes, length)
            if at < len(open_sizes):
                gap = open_sizes[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    open_sizes.pop(at)
            else:
                gap = capacity
                count = -(-left // (capacity // length))
                first, windows = windows, windows + count
            per = gap // length
            whole = min(count, left // per)
            if whole:
                plan.append((length, rank, whole * per, first, per, capacity - gap))
                free(gap - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if left and whole < count:  # the last window takes what is left
                plan.append((length, rank, left, first + whole, left, capacity - gap))
                free(gap - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            free(gap, first + whole, count - whole)
    return plan


def ranked(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Pieces with ``rank`` (from 0 within their length) and the number of pieces of each length.

    A sort by range over the cluster; inside a partition Spark numbers the rows
    itself. The rows per partition and length are counted, and their prefix sums
    shift the numbers. A length with many pieces spreads over many partitions.
    """
    order = ["length", "ids_crc32", "doc_id", "piece"]
    pieces, _ = materialise(pieces, "pack")  # the sort samples its input first, which would tokenise twice
    sorted_rows = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    kept, _ = materialise(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "pack")
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    runs = sorted(kept.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low")).collect())
    counts: dict[int, int] = {}
    shifts = []
    for length, part, n, low in runs:
        shifts.append((length, part, counts.get(length, 0) - low))
        counts[length] = counts.get(length, 0) + n
    shift = kept.sparkSession.createDataFrame(shifts, "length bigint, _part bigint, _shift bigint")
    rows = kept.join(F.broadcast(shift), ["length", "_part"])  # at most one row per partition and length border
    return rows.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"), counts


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Other columns are not kept."""
    spark = docs.sparkSession
    bounded_batches(docs)
    rows = docs.select(plain(id_col).cast("bigint").alias("doc_id"),
                       pieces_of(text_of(plain(text_col)), tokenizer_file, capacity, end_id).alias("p"))
    rows, counts = ranked(rows.select("doc_id", F.inline("p")))
    plan = plan_rounds(counts, capacity)
    kind = "length bigint, _rank bigint, _n bigint, _window bigint, _per bigint, _offset bigint"
    # One entry per match of two runs; bounded by the square of the capacity, in practice a few thousand rows.
    matches = spark.createDataFrame(plan, kind).groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("_rank", "_n", "_window", "_per", "_offset"))).alias("_plan"))
    rows = rows.join(F.broadcast(matches), "length")
    mine = F.filter("_plan", lambda m: (m["_rank"] <= F.col("rank")) & (F.col("rank") < m["_rank"] + m["_n"]))[0]
    rows = rows.withColumn("_m", mine).withColumn("_k", F.col("rank") - F.col("_m._rank"))
    return rows.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_m._window") + F.expr("_k div _m._per")).alias("sequence_id"),
        (F.col("_m._offset") + F.col("length") * F.expr("_k % _m._per")).alias("offset"))
