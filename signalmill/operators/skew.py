"""Joins, previous-row lookups and quantiles that do not rely on even keys.

One key may hold a third of all rows. Nothing here gathers the rows of one key
in one task: previous rows are found per time chunk, join rows of hot keys are
spread over several copies of the matching row, and ranks are narrowed down by
counts before any values are sorted.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOT_ROWS = 1_000_000
NULL_SLOTS = 1 << 20


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                  chunk: Column) -> DataFrame:
    """Adds ``prev_<v>``: the value of ``v`` in the preceding row of the same key.

    Equal to ``lag(v) over (partition by keys order by order)`` as long as
    ``chunk`` never falls when ``order`` rises. The rows of a key are sorted per
    chunk only; what crosses a chunk border is one last row per key and chunk,
    found by a partial aggregate. NULL keys form a group of their own.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.withColumns(
        {n: F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for n, k in zip(names, keys)}
        | {"_chunk": chunk})
    inside = W.partitionBy(*names, "_chunk").orderBy(*order)
    rows = keyed.withColumns(
        {f"_in_{v}": F.lag(v).over(inside) for v in values}
        | {"_head": F.row_number().over(inside) == 1})
    tails = keyed.groupBy(*names, "_chunk").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *names, "_chunk",
        F.lag("_tail").over(W.partitionBy(*names).orderBy("_chunk")).alias("_carry"))
    joined = rows.join(carried, [*names, "_chunk"], "left")
    previous = {
        f"prev_{v}": F.when(F.col("_head"), F.col(f"_carry.{v}")).otherwise(F.col(f"_in_{v}"))
        for v in values}
    return joined.select(*df.columns, *[c.alias(n) for n, c in previous.items()])


def balanced_edges(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` cut points that split ``column`` into even row counts.

    For data bunched in time: ``chunk_of(col, edges)`` then gives chunks of like
    size whatever the distribution. Only the cut points reach the driver.
    """
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, shares, 10_000)).first()[0]
    return sorted(set(found or []))


def chunk_of(column: Column, edges: list[int]) -> Column:
    """Number of edges at or below the value: rises with the value."""
    cuts = F.array(*[F.lit(e).cast("bigint") for e in edges])
    return F.size(F.filter(cuts, lambda e: e <= column)).cast("bigint")


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Joins ``left`` to ``right``, which holds at most one row per ``on`` key.

    Keys with ``hot_rows`` rows or more on the left are spread over several join
    keys of about ``hot_rows`` rows, with as many copies of their one right row.
    The rows of all keys are counted, with partial sums before the shuffle; the
    table of hot keys is an ordinary join side, broadcast only if Spark finds it
    small. Left rows with a NULL key match nothing and are spread as well. A row's
    slot comes from all its columns.
    """
    hot = (left.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
           .where(F.col("_rows") >= hot_rows)
           .select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_copies")))
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    null_key = F.lit(False)
    for k in on:
        null_key = null_key | F.col(k).isNull()
    slot = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.when(null_key, F.lit(NULL_SLOTS)).otherwise(copies)).cast("int")
    spread = left.join(hot, on, "left").withColumn("_slot", slot).drop("_copies")
    copied = (right.join(hot, on, "left")
              .withColumn("_slot", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies"))
    return spread.join(copied, [*on, "_slot"], how).drop("_slot")


def _cell(value: Column) -> Column:
    """A number that never falls when the value rises; about 0.1 % wide, under 1.1 million in all. NaN is above all."""
    size = F.log2(F.abs(value) * 1e6 + 1.0) * 1024.0
    cell = F.floor(F.signum(value) * size).cast("bigint")
    # Never NULL, so that the join on it adds no filter and both of its sides share one shuffle.
    return F.coalesce(F.when(F.isnan(value.cast("double")), F.lit(1 << 40)).otherwise(cell), F.lit(0).cast("bigint"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, str],
                    interpolate: bool = False) -> DataFrame:
    """Exact quantiles per group, for groups of any size.

    ``shares`` maps an output column to a share written as decimal text, such as
    ``{"p95": "0.95"}``. Without ``interpolate`` the result is the smallest value
    whose cumulative share reaches the quantile; with it, the linear
    interpolation between the two neighbouring ranks. NULL values are left out.

    Equal values are counted first; the counts are summed per cell (a monotone
    coarse value, a bounded number per group), the cell that holds the wanted
    rank is found from those sums, and only the values of that one cell are put
    in order. The keys travel as one struct, in which NULL equals NULL.
    """
    counts = (df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_key"), value).groupBy("_key", value)
              .agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", _cell(F.col(value))))
    cells = counts.groupBy("_key", "_cell").agg(F.sum("_n").alias("_n"))
    group = W.partitionBy("_key")
    upto = group.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    total = F.col("_total").cast("decimal(20,0)")
    wanted = []
    for name, share in shares.items():
        q = F.lit(Decimal(share)).cast("decimal(10,8)")
        if interpolate:
            at = q * (total - 1)
            wanted.append((name, "lo", F.floor(at).cast("bigint") + 1))
            wanted.append((name, "hi", F.ceil(at).cast("bigint") + 1))
        else:
            wanted.append((name, "lo", F.greatest(F.ceil(q * total).cast("bigint"), F.lit(1).cast("bigint"))))
    ranks = F.array(*[F.struct(F.lit(f"{n}.{side}").alias("id"), r.alias("rank")) for n, side, r in wanted])
    hits = (cells.withColumns({"_total": F.sum("_n").over(group), "_upto": F.sum("_n").over(upto)})
            .withColumn("_before", F.col("_upto") - F.col("_n"))
            .withColumn("_want", F.filter(ranks, lambda r: (r["rank"] > F.col("_before")) & (r["rank"] <= F.col("_upto"))))
            .where(F.size("_want") > 0)
            .select("_key", "_cell", "_before", "_total", F.explode("_want").alias("_want")))
    in_cell = W.partitionBy("_key", "_cell", "_want.id").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    found = (counts.join(hits, ["_key", "_cell"])
             .withColumn("_upto", F.col("_before") + F.sum("_n").over(in_cell))
             .where((F.col("_want.rank") <= F.col("_upto")) & (F.col("_want.rank") > F.col("_upto") - F.col("_n"))))
    picked = found.groupBy("_key").agg(
        F.max("_total").alias("_total"),
        *[F.max(F.when(F.col("_want.id") == f"{n}.{side}", F.col(value))).alias(f"_{n}_{side}")
          for n, side, _ in wanted])
    out = []
    for name, share in shares.items():
        lo = F.col(f"_{name}_lo")
        if interpolate:
            at = F.lit(float(share)) * (F.col("_total") - 1).cast("double")
            out.append((lo + (F.col(f"_{name}_hi") - lo) * (at - F.floor(at).cast("double"))).alias(name))
        else:
            out.append(lo.alias(name))
    return picked.select("_key.*", *out)
