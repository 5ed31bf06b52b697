"""Mixing sources to target weights, in DataFrame expressions only.

The words of each source, its documents one after another, are packed into
blocks of ``block`` words. Output shards of ``shard`` slots draw how many slots
each source gets from the multinomial distribution of the targets (with
stratified uniforms, which keeps each count near its expectation). The k-th slot
of a source goes to block ``perm(k)``, a pseudorandom permutation of the
source's block numbers, once around for each pass over the source; slots and
blocks are joined by source and block number.

Where documents start inside a source comes from two levels of prefix sums:
over hash buckets, and over the documents of one bucket. So a source of any size
is never in one task, and the slots of a source are numbered per shard.

Sources are weighted 5, 2, 1, repeating, in order of their code points, NULL
last. A source takes at most ``most`` times its words; the excess is reshared by
weight. NULL texts have no words; documents without words take nothing, rows
that repeat are rows of their own, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from signalmill.llm.common import BETWEEN_WORDS, count_words, plain, text_of
from signalmill.session import materialise

WEIGHTS = (5, 2, 1)
BUCKETS = 4096
CELLS = 4096
#: Primes above any likely divisor structure; of any block number, at least one of them is no factor.
PRIMES = (2654435761, 2246822519, 3266489917, 668265263)


def targets(sizes: DataFrame, block: int, most: float = 3.0) -> DataFrame:
    """``source, source_size`` to ``target``, ``blocks``, ``draws`` (slots wanted) and the source's range of all draws.

    Water-filling: sources in order of the level at which they are full; the
    sources before the first one that is not full take ``most`` times their
    size, the others share the rest by weight. One row per source.
    """
    n = len(WEIGHTS)
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    rows = sizes.withColumn("place", place)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.col("place") - 1, F.lit(n)) + 1))
    rows = rows.withColumn("full", most * F.col("source_size"))
    by_level = W.orderBy(F.col("full") / F.col("weight"), "place")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    rows = rows.withColumns({
        "rest": F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    rows = rows.withColumn("level", F.when(F.col("rest") / F.col("open") * F.col("weight") <= F.col("full"), F.col("rest") / F.col("open")))
    rows = rows.withColumn("level", F.max_by("level", F.when(F.col("level").isNotNull(), -F.col("full") / F.col("weight"))).over(every))
    # Every source full: only when there are no words at all.
    rows = rows.withColumn("target", F.least(F.col("full"), F.coalesce(F.col("level") * F.col("weight"), F.col("full"))))
    # The last block of a source may be short: slots are counted at the source's mean block.
    rows = rows.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    rows = rows.withColumn("draws", F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0)))
    upto = F.sum("draws").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("low", F.try_divide(upto - F.col("draws"), F.sum("draws").over(every)))
    high = F.coalesce(F.lead("low").over(W.orderBy("place")), F.lit(1.0))  # the ranges meet exactly
    return rows.select("source", "place", "source_size", "target", "blocks", "draws", "low", high.alias("high"))


def fingerprint(id_col: str, text_col: str) -> Column:
    return F.xxhash64(plain(id_col).cast("string"), text_of(plain(text_col)))


def _draw(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on its arguments only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def permuted(k: Column, n: Column, seed: Column) -> Column:
    """A permutation of 0 .. n-1: multiplication by a prime that does not divide n, and a shift drawn from ``seed``."""
    prime = F.lit(PRIMES[-1])
    for p in PRIMES[-2::-1]:
        prime = F.when(n % F.lit(p) != 0, F.lit(p)).otherwise(prime)
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  the product of two longs
    return ((wide(k) * wide(prime % n) + wide(F.pmod(F.xxhash64(seed), n))) % wide(n)).cast("bigint")


def mix(docs: DataFrame, block: int = 64, shard: int = 65_536, most: float = 3.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Documents with what the mix takes of them, and the slots of the output.

    Documents: ``doc_id, source, size, source_size, target, taken`` and
    ``_print``, a checksum of id and text. Slots: ``shard, slot, place, k,
    block``; a slot holds the words of that block of the source at that place.
    """
    size = count_words(text_of(plain(text_col)), BETWEEN_WORDS)
    sized = docs.select(plain(id_col).cast("bigint").alias("doc_id"), plain(source_col).cast("string").alias("source"), size.alias("size"),
                        fingerprint(id_col, text_col).alias("_print"))
    sized, _ = materialise(sized, "mix")  # the texts are read once
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = materialise(targets(per_source, block, most).coalesce(1), "mix-goals")[0]  # a row per source
    # Ordinary equality from here on: sources go by their place.
    placed = sized.join(goals.select("source", "place", "source_size", "target"), sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "_print"), F.lit(BUCKETS)))
    inside = W.partitionBy("place", "bucket").orderBy("doc_id", "_print", "size")
    rows = placed.withColumns({"n": F.row_number().over(inside),
                               "start": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")})
    buckets = placed.groupBy("place", "bucket").agg(F.sum("size").alias("_words"))
    ahead = W.partitionBy("place").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.select("place", "bucket", F.coalesce(F.sum("_words").over(ahead), F.lit(0).cast("bigint")).alias("shift"))
    rows = rows.join(buckets, ["place", "bucket"]).withColumn("start", F.col("start") + F.col("shift"))
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    parts = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    slots = draw_slots(goals, shard, most)
    times = slots.groupBy("place", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = F.coalesce(F.sum(words * F.coalesce("times", F.lit(0))), F.lit(0)).cast("bigint")
    out = (parts.join(times, ["place", "block"], "left")
           .groupBy("place", "bucket", "n").agg(taken.alias("taken"), *[F.first(c).alias(c) for c in (
               "doc_id", "source", "size", "source_size", "target", "_print")]))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "_print"), slots


def draw_slots(goals: DataFrame, shard: int, most: float) -> DataFrame:
    """``shard, slot, place, k, block`` for every slot that a source's targets call for."""
    spark = goals.sparkSession
    n = round(goals.agg(F.sum("draws")).first()[0] or 0)
    slots = spark.range(n).select(F.expr(f"id div {shard}").alias("shard"), F.expr(f"id % {shard}").alias("slot"))
    # Stratified: one uniform in each n-th of a shard's range.
    here = F.least(F.lit(shard), F.lit(n) - F.col("shard") * shard)
    slots = slots.withColumn("u", (F.col("slot") + _draw("shard", "slot")) / here)
    # A slot finds its source by the cell of its uniform; each source covers a range of cells.
    ranges = goals.where("draws > 0 and high > low").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1).cast("bigint")))))
    slots = (slots.withColumn("cell", F.floor(F.col("u") * CELLS)).join(ranges, "cell")
             .where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))))
    counts = slots.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy("place").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "place", F.coalesce(F.sum("_n").over(ahead), F.lit(0).cast("bigint")).alias("_shift"))
    mine = W.partitionBy("shard", "place").orderBy(_draw("slot", "shard"), "slot")
    slots = slots.withColumn("k", F.row_number().over(mine) - 1).join(counts, ["shard", "place"]).withColumn("k", F.col("k") + F.col("_shift"))
    slots = slots.where(F.col("k") < F.floor(F.lit(most)).cast("bigint") * F.col("blocks"))  # never a further pass
    k, b = F.col("k"), F.col("blocks")
    return slots.select("shard", "slot", "place", "k", permuted(k % b, b, F.concat_ws(":", "place", F.expr("k div blocks"))).alias("block"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as documents, with all their columns: each row ``taken / size`` times, the fraction decided by a draw.

    Rows equal in id and text share their mean, so that each of them is decided alike.
    """
    rows, _ = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    share = rows.groupBy("_print").agg(F.sum("taken").alias("_t"), F.sum("size").alias("_s"))
    share = share.select(F.col("_print").alias("_mix_print"), F.coalesce(F.try_divide("_t", "_s"), F.lit(0.0)).alias("_mix_share"))
    times = F.floor(F.col("_mix_share")) + (_draw("_mix_print") < F.col("_mix_share") % 1).cast("bigint")
    out = docs.withColumn("_mix_print", fingerprint(id_col, text_col)).join(share, "_mix_print").withColumn("_mix_times", times)
    out = out.where("_mix_times > 0").withColumn("_mix_times", F.explode(F.sequence(F.lit(1).cast("bigint"), "_mix_times")))
    return out.select(*[plain(c) for c in docs.columns])
