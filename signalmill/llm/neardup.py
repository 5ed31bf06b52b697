"""Near-duplicate vectors by a blocked product, in rounds.

The vectors of a label that have one length are dealt into chunks of ``TILE``
rows and ``TILE_BYTES`` at most. In round ``r`` each chunk meets the one ``r``
places further on, so every pair of chunks meets in one round and a round ships
a vector twice at most. Its shuffle is gone before the next one begins: the disk
taken is a fixed multiple of the vectors, while the work inside a label grows
with its square.

A tile orders both chunks by halving them along their widest dimension. Steps of
``_STEP`` by ``STEPS`` rows whose bounding boxes are further apart than linked
vectors can be are skipped, the others multiplied in single precision. What lies
within the error of that product is checked exactly, by cosine in double
precision. Each linked vector of a tile gets its number of links there and the
smallest one it is connected to in the tile; no pair is written. Equal vectors of
one label travel as one, with a weight.

NULL labels, and vectors that are NULL, zero or hold NULL or non-finite
components link with nothing; vectors of different length do not either. Repeated
rows are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from signalmill.llm.common import plain
from signalmill.llm.components import components, forest
from signalmill.session import materialise

TILE = 32_768  # rows of a chunk
TILE_BYTES = 16 << 20  # of a chunk, in double precision
_STEP = 256
STEPS = 2048
EXACT = 1 << 16  # pairs that are checked at once


def placed(vectors: Column) -> Column:
    """Struct of ``dim``, ``raw`` (components, in single precision where that loses nothing) and ``key`` (equal for equal vectors).

    NULL for vectors that link with nothing.
    """
    kind = pa.struct([("dim", pa.int32()), ("raw", pa.binary()), ("key", pa.binary())])

    @F.arrow_udf("struct<dim: int, raw: binary, key: binary>")
    def place(arrays: pa.Array) -> pa.Array:
        out = []
        for v in arrays:
            x = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.empty(0)  # NULL components are NaN
            if not len(x) or not np.isfinite(x).all() or not x.any():
                out.append(None)
                continue
            x = x.astype(np.float64) + 0.0  # one zero, not two
            with np.errstate(over="ignore"):
                single = x.astype(np.float32)
            raw = (single if (single == x).all() else x).tobytes()
            out.append({"dim": len(x), "raw": raw, "key": xxhash.xxh3_128_digest(raw, len(x))})
        return pa.array(out, kind)

    return place(vectors)


def _vectors(side: list[tuple], dim: int) -> np.ndarray:
    kinds = [np.float32 if len(r[2]) == 4 * dim else np.float64 for r in side]
    return np.stack([np.frombuffer(r[2], k).astype(np.float64) for r, k in zip(side, kinds)])


def halved(x: np.ndarray) -> np.ndarray:
    """An order of rows in which each run of ``_STEP`` lies close together."""
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= _STEP:
            done.append(rows)
            continue
        widest = np.ptp(x[rows], axis=0).argmax()
        at = -(-len(rows) // (2 * _STEP)) * _STEP
        rows = rows[np.argpartition(x[rows, widest], at - 1)]
        todo += [rows[at:], rows[:at]]
    return np.concatenate(done)


def _apart(a: np.ndarray, b: np.ndarray, at: list[int], to: list[int]) -> np.ndarray:
    """Squared distances between the bounding boxes of runs of rows."""
    low, high = ([f.reduceat(x, cut, axis=0) for x, cut in ((a, at), (b, to))] for f in (np.minimum, np.maximum))
    return np.stack([(np.maximum(0, np.maximum(low[1] - high[0][k], low[0][k] - high[1])) ** 2).sum(1) for k in range(len(at))])


def _tile(visitors: list[tuple], residents: list[tuple], dim: int, cosine: float) -> Iterator[tuple[int, int, int]]:
    """Links and roots of two chunks, or of one: then both sides are the same list, and each pair is looked at once."""
    same = visitors is residents
    ids, weights, scaled, norms, unit = [], [], [], [], []
    for side in (visitors, residents)[same:]:
        x = _vectors(side, dim)
        x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
        length = np.linalg.norm(x, axis=1)
        order = halved(y := (x / length[:, None]).astype(np.float32))
        scaled.append(x[order])
        norms.append(length[order])
        unit.append(y[order])
        ids.append(np.array([r[0] for r in side])[order])
        weights.append(np.array([r[1] for r in side])[order])
    ids, weights, scaled, norms, unit = ([x[0], x[-1]] for x in (ids, weights, scaled, norms, unit))
    error = (unit[0].shape[1] + 8) * 2.0 ** -23
    at, to = list(range(0, len(ids[0]), _STEP)), list(range(0, len(ids[1]), STEPS))
    near = _apart(*unit, at, to) <= 2 - 2 * cosine + 4 * error
    links = [np.zeros(len(i), np.int64) for i in ids]
    above: dict[int, int] = {}

    def top(node: int) -> int:
        while (up := above.setdefault(node, node)) != node:
            above[node] = node = above[up]
        return node

    for i, j in np.argwhere(near).tolist():
        rows, columns = slice(at[i], at[i] + _STEP), slice(to[j], to[j] + STEPS)
        if same and columns.stop <= rows.start:
            continue
        found = unit[0][rows] @ unit[1][columns].T
        linked = found >= cosine - error
        if not linked.any():
            continue
        if same:
            linked &= np.arange(rows.start, rows.start + len(found))[:, None] < np.arange(columns.start, columns.start + found.shape[1])[None]
        linked &= ids[0][rows][:, None] != ids[1][columns][None]
        close = np.argwhere(linked & (found < cosine + error))
        for k in range(0, len(close), EXACT):
            a, b = close[k:k + EXACT].T
            exact = (scaled[0][rows][a] * scaled[1][columns][b]).sum(1) / (norms[0][rows][a] * norms[1][columns][b])
            linked[a, b] = exact >= cosine
        own, others = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(own):
            continue
        linked = linked[np.ix_(own, others)]
        own, others = own + rows.start, others + columns.start
        links[0][own] += linked @ weights[1][others]
        links[1][others] += weights[0][own] @ linked
        for node, low in forest(linked, ids[0][own], ids[1][others]).items():
            x, y = top(node), top(low)
            above[max(x, y)] = min(x, y)
    if same:
        ids, links = ids[:1], [links[0] + links[1]]
    for i, n in zip(ids, links):
        for k in np.flatnonzero(n).tolist():
            yield int(i[k]), int(n[k]), top(int(i[k]))


def _tiles(cosine: float, alone: bool):
    """alone: chunks by themselves; else tiles of two, of which one may have no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("label", "dim", "i", "visits", "rep", "weight", "raw")
        stream = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in names)))
        for key, rows in groupby(stream, key=lambda r: r[:3]):
            sides: tuple[list, list] = ([], [])
            for r in rows:
                sides[not r[3]].append(r[4:])
            if sides[0] and (alone or sides[1]):
                out = list(_tile(sides[0], sides[not alone], key[1], cosine))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rep", "links", "root"])

    return run


def seats(dealt: DataFrame, by: int) -> DataFrame:
    """Rows of a chunk of ``chunks``, in the tiles of the round in which chunks ``by`` places apart meet."""
    seat = lambda i, visits: F.struct(i.cast("int").alias("i"), F.lit(visits).alias("visits"))
    if not by:
        return dealt.select("*", F.inline(F.array(seat(F.col("chunk"), True))))
    # Halfway round, two chunks would meet twice.
    first = (2 * by < F.col("chunks")) | ((2 * by == F.col("chunks")) & (F.col("chunk") < by))
    second = (2 * by < F.col("chunks")) | ((2 * by == F.col("chunks")) & (F.col("chunk") >= by))
    both = F.array(F.when(first, seat(F.col("chunk"), True)), F.when(second, seat(F.pmod(F.col("chunk") - by, F.col("chunks")), False)))
    return dealt.select("*", F.inline(F.array_compact(both)))


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``. Other columns are not kept."""
    rows = vectors.select(plain(id_col).cast("bigint").alias("vec_id"), plain(label_col).cast("string").alias("label"),
                          plain(vector_col).cast("array<double>").alias("v"))
    found, _ = materialise(rows.select("vec_id", "label", placed(F.col("v")).alias("p")).select("vec_id", "label", "p.*"), "vectors")
    able = found.where("raw is not null and label is not null and vec_id is not null")
    classes, _ = materialise(able.groupBy("label", "key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("dim").alias("dim"), F.first("raw").alias("raw")), "vectors")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.count(F.lit(1)) * F.col("dim") * 8 / TILE_BYTES)).cast("int")
    cut, seen = materialise(classes.groupBy("label", "dim").agg(chunks.alias("chunks")).where("chunks > 1"), "vectors", most=F.max("chunks"))
    # A row stands for at least half a chunk of vectors, so there are few.
    dealt = classes.join(F.broadcast(cut), ["label", "dim"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    keys = ["label", "dim", "i"]

    def met(by: int) -> DataFrame:
        tiles = seats(dealt, by).select(*keys, "visits", "rep", "weight", "raw").repartition(*keys).sortWithinPartitions(*keys)
        return materialise(tiles.mapInArrow(_tiles(cosine, not by), "rep bigint, links bigint, root bigint"), "vector-links")[0]

    linked = reduce(DataFrame.unionAll, [met(by) for by in range((seen["most"] or 1) // 2 + 1)])
    reached = components(linked.select(F.col("root").alias("a"), F.col("rep").alias("b")), "vector-links")
    links = linked.groupBy("rep").agg(F.sum("links").alias("_links"))
    known = (classes.select("label", "key", "rep", "weight").join(links, "rep", "left")
             .join(reached.withColumnRenamed("node", "rep"), "rep", "left")
             .select("label", "key", "weight", F.coalesce("component", "rep").alias("_component"), F.coalesce("_links", F.lit(0)).alias("_links")))
    out = found.select("vec_id", "label", "key").join(known, ["label", "key"], "left").select(
        "vec_id", F.coalesce(F.col("_links") + F.col("weight") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("_component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
