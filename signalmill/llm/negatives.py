"""Hard negatives by angular triangle filtering.

Vectors are scaled and rounded down to whole numbers; a score is the inner
product of two of them, exact. Every vector stores its norm and its angles to
``PIVOTS`` reference directions. If two vectors lie at angles s and t to a
direction, the angle between them is at least ``|s - t|`` and at most ``s + t``
and ``2 pi - s - t``. The tightest of these over all directions, multiplied by
the norms and widened for rounding, bounds the score without its computation.

Vectors are sorted by label, nearest direction and angle to it over the whole
cluster and cut into blocks of ``ROWS`` of one label; anchors are sorted and cut
likewise. A block keeps the range of its norms and of its angles to each
direction, so the bound holds for two blocks as well. Blocks whose bound cannot
reach the window of any anchor are never joined; inside two joined blocks, the
same bound is taken for each anchor and each run of ``RUN`` rows, and only the
runs whose bound overlaps the anchor's window get integer scores.

The window of a positive reaches from the anchor's fifth best score up: first
each block of anchors is scored against its most promising block, which gives
the score to beat. The window of a negative follows from the positive's score.
The blocks of anchors meet the blocks of rows by an equi-join on dimension and a
salt; their table is smaller than the vectors by the size of a block, and no
pair of vectors is ever written but the best of each anchor in each two blocks.

Directions are means of groups in a bounded sample of ``SAMPLE`` vectors (least
hashes of the id); they decide how much is pruned, never what is found.

Rows with a NULL id, a NULL label, a NULL or empty vector, or any NULL or
non-finite component take no part, nor do vectors whose rounded norm is 2^31 or
more, for their scores might not fit into 64 bits. Vectors of different
dimension are not compared. Rows equal in id, label and vector count once. Equal
scores go by the smaller id. Anchors without a positive, and positives without
a negative in their window, give no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalmill.llm.common import plain
from signalmill.session import materialise

PIVOTS = 16
SAMPLE = 2048
ROWS = 1024
ANCHORS = 256
RUN = 64
SALTS = 64
SLACK = 1e-6  # radians; angles are kept in single precision
_EXACT = float(1 << 52)

_PLACED = "vec_id bigint, label bigint, anchor boolean, dim int, cell int, angle float, norm double, raw binary, angles binary"
_BLOCK = ("block bigint, dim int, label bigint, n int, raw binary, ids binary, norms binary, angles binary, "
          "norm_low double, norm_high double, low array<double>, high array<double>")


def directions(sample: np.ndarray) -> np.ndarray:
    """Unit vectors that lie near the sample's groups: farthest points first, then means of the nearest."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(PIVOTS, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    out = unit[chosen]
    for _ in range(4):
        at = (unit @ out.T).argmax(1)
        sums = np.stack([unit[at == k].sum(0) for k in range(len(out))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(size > 1e-6, sums / np.maximum(size, 1e-300), out)
    return out


def angles_to(x: np.ndarray, norm: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T / np.maximum(norm, 1e-300)[:, None], -1, 1)).astype(np.float32)


def smallest(x: np.ndarray) -> np.ndarray:
    """Whole numbers in 16 bits where they fit, which all rows of a block do or do not."""
    return x.astype("<i2") if len(x) == 0 or np.abs(x).max() < 1 << 15 else x.astype("<i8")


def vectors_of(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * n * dim else "<i8").reshape(n, dim)


def rounded(lists: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and whole-number vectors of one length each; rows that take no part are left out."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = lists.offsets.to_numpy()
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        x = values[starts[rows][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * x)
            fits = np.isfinite(x).all(1) & (np.sqrt((x * x).sum(1)) < 2.0 ** 31)
        yield rows[fits], x[fits]


def _placed(scale: float, pivots: dict[int, np.ndarray]):
    names = [c.split()[0] for c in _PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, anchors = (b.column(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "label", "anchor"))
            for rows, x in rounded(b.column("v"), scale):
                if not len(rows):
                    continue
                dim = x.shape[1]
                norm = np.sqrt((x * x).sum(1))
                angles = angles_to(x, norm, pivots.get(dim, np.full((1, dim), dim ** -0.5)))
                cell = angles.argmin(1)
                whole = x.astype("<i8")
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[rows], pa.int64()), pa.array(labels[rows], pa.int64()), pa.array(anchors[rows].astype(bool)),
                    pa.array(np.full(len(rows), dim, np.int32)), pa.array(cell.astype(np.int32)),
                    pa.array(angles[np.arange(len(rows)), cell]), pa.array(norm),
                    pa.array([smallest(v).tobytes() for v in whole], pa.binary()),
                    pa.array([a.tobytes() for a in angles], pa.binary())], names)

    return run


def _blocks(size: int):
    """Sorted rows to blocks of at most ``size`` rows of one label and dimension."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    numbers = pa.list_(pa.float64())
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.float64(), pa.float64(), numbers, numbers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32

        def block(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
            nonlocal made
            made += 1
            x = np.stack([vectors_of(r[4], 1, key[0])[0] for r in rows])
            angles = np.stack([np.frombuffer(r[5], "<f4") for r in rows])
            norms = np.array([r[3] for r in rows])
            row = (made, *key, len(rows), smallest(x).tobytes(), np.array([r[2] for r in rows], "<i8").tobytes(), norms.tobytes(),
                   angles.tobytes(), norms.min(), norms.max(), angles.min(0).astype(float) - SLACK, angles.max(0).astype(float) + SLACK)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        def stream() -> Iterator[tuple]:
            last = None
            for b in batches:
                for r in zip(*(b.column(n).to_pylist() for n in ("dim", "label", "vec_id", "norm", "raw", "angles"))):
                    if last is None or r[:3] != last[:3] or r[4] != last[4]:  # repeated rows stand together
                        yield r
                    last = r

        for key, rows in groupby(stream(), key=lambda r: r[:2]):
            held: list[tuple] = []
            for r in rows:
                held.append(r)
                if len(held) == size:
                    yield block(key, held)
                    held = []
            if held:
                yield block(key, held)

    return run


def blocks(placed: DataFrame, size: int) -> DataFrame:
    order = ["dim", "label", "cell", "angle", "vec_id", "raw"]  # the id parts equal vectors
    kept, _ = materialise(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(size), _BLOCK), "negatives")
    return kept


def bounds(a_low, a_high, b_low, b_high, a_norms, b_norms, np=np):
    """Score bounds from ranges of angles (last axis: directions) and of norms (pairs of low and high)."""
    gap = np.maximum(np.maximum(a_low - b_high, b_low - a_high).max(-1), 0)
    wide = np.minimum(np.minimum(a_high + b_high, 2 * np.pi - a_low - b_low).min(-1), np.pi)
    large, small = a_norms[1] * b_norms[1], a_norms[0] * b_norms[0]

    def times(cosine, up: bool):
        value = cosine * np.where((cosine >= 0) == up, large, small)
        slack = 1 + 1e-9 * large
        return value + slack if up else value - slack

    return times(np.cos(wide), False), times(np.cos(gap), True)


def scores(a: np.ndarray, b: np.ndarray, a_norm: float, b_norm: float) -> np.ndarray:
    """Exact inner products. Every partial sum is at most the product of the norms."""
    if a_norm * b_norm < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(found: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Row and column of the ``k`` highest allowed entries of each row; equal ones by smaller id."""
    rows = np.flatnonzero(allowed.any(1))
    if not len(rows):
        return
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))[::-1]
    width = max(len(ids), 1)
    if np.abs(found).max() < (1 << 61) // width:
        key = np.where(allowed[rows], found[rows] * width + place, np.iinfo(np.int64).min)
        top = np.argpartition(key, max(len(ids) - k, 0), axis=1)[:, -k:] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), key.shape)
        for r, columns, good in zip(rows.tolist(), top.tolist(), (np.take_along_axis(key, top, 1) > np.iinfo(np.int64).min).tolist()):
            yield from ((r, c) for c, ok in zip(columns, good) if ok)
        return
    for r in rows.tolist():
        columns = np.flatnonzero(allowed[r])
        yield from ((r, c) for c in columns[np.lexsort((ids[columns], -found[r, columns]))][:k].tolist())


class Side:
    """One block, read from its row."""

    def __init__(self, row: dict, prefix: str):
        self.n, self.dim = row[prefix + "n"], row["dim"]
        self.x = vectors_of(row[prefix + "raw"], self.n, self.dim)
        self.ids = np.frombuffer(row[prefix + "ids"], "<i8")
        self.norms = np.frombuffer(row[prefix + "norms"], "<f8")
        self.angles = np.frombuffer(row[prefix + "angles"], "<f4").reshape(self.n, -1).astype(np.float64)


def runs_in_reach(a: Side, b: Side, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each anchor and each run of ``RUN`` rows of ``b``, whether the score bounds overlap the anchor's window."""
    starts = np.arange(0, b.n, RUN)
    over = lambda f, x: f.reduceat(x, starts, axis=0)
    b_low, b_high = over(np.minimum, b.angles) - SLACK, over(np.maximum, b.angles) + SLACK
    b_norms = over(np.minimum, b.norms)[None], over(np.maximum, b.norms)[None]
    least, most = bounds(a.angles[:, None] - SLACK, a.angles[:, None] + SLACK, b_low[None], b_high[None],
                         (a.norms[:, None], a.norms[:, None]), b_norms)
    return (most >= low[:, None]) & (least <= high[:, None])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {n: b.column(n)[k].as_py() for n in b.schema.names}


def in_reach(a: Side, b: Side, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Columns of ``b`` that some anchor can reach, with the anchors' scores against them."""
    near = runs_in_reach(a, b, low, high)
    columns = np.flatnonzero(np.repeat(near.any(0), RUN)[:b.n])
    return (columns, scores(a.x, b.x[columns], a.norms.max(), b.norms[columns].max())) if len(columns) else None


def _positives(k: int):
    """The ``k`` best rows of each anchor in a pair of blocks, where they reach the anchor's score to beat."""
    names = ["anchor_id", "positive_id", "positive_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            a, b = Side(row, "a_"), Side(row, "b_")
            beat = np.array([-2.0 ** 62 if v is None else v for v in row["a_beat"] or [None] * a.n])
            got = in_reach(a, b, beat, np.full(a.n, np.inf))
            if got is None:
                continue
            columns, found = got
            ids = b.ids[columns]
            allowed = (a.ids[:, None] != ids[None]) & (found >= beat[:, None])
            out = [(int(a.ids[r]), int(ids[c]), int(found[r, c])) for r, c in best(found, ids, allowed, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return run


def _negatives(k: int, percent: tuple[int, int]):
    """The ``k`` best rows of each anchor and positive in a pair of blocks, inside the positive's window."""
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            a, b = Side(row, "a_"), Side(row, "b_")
            of = [p or [] for p in row["a_positives"]]
            # 100 * score within percent[0] and percent[1] times the positive's score, as whole numbers.
            lows = [[-(-percent[0] * p["positive_score"] // 100) for p in ps] for ps in of]
            highs = [[percent[1] * p["positive_score"] // 100 for p in ps] for ps in of]
            got = in_reach(a, b, np.array([min(v, default=np.inf) for v in lows]), np.array([max(v, default=-np.inf) for v in highs]))
            if got is None:
                continue
            columns, found = got
            ids, out = b.ids[columns], []
            for place in range(max(map(len, of))):
                have = np.array([len(ps) > place for ps in of])
                low, high = (np.array([v[place] if len(v) > place else 0 for v in vs]) for vs in (lows, highs))
                allowed = (found >= low[:, None]) & (found <= high[:, None]) & have[:, None]
                for r, c in best(found, ids, allowed, k):
                    p = of[r][place]
                    out.append((int(a.ids[r]), p["positive_id"], p["positive_score"], int(ids[c]), int(found[r, c])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return run


def _met(anchors: DataFrame, rows: DataFrame, same_label: bool) -> DataFrame:
    """Pairs of blocks, ``a_block, b_block, least, most`` with the bounds of their scores; anchors' columns come along.

    Joined on dimension and salt, so that the pairs of one dimension are many tasks' work.
    """
    def facts(df: DataFrame, side: str) -> DataFrame:
        return df.select("dim", *[F.col(c).alias(f"{side}_{c}") for c in ("block", "label", "n", "norm_low", "norm_high", "low", "high")],
                         *[c for c in ("reach_low", "reach_high") if c in df.columns])

    a = facts(anchors, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    b = facts(rows, "b").withColumn("salt", F.pmod(F.xxhash64("b_block"), F.lit(SALTS)).cast("int"))
    label = F.col("a_label") == F.col("b_label")
    met = a.join(b, ["dim", "salt"]).where(label if same_label else ~label)
    largest = lambda x: F.array_max(x)
    gap = F.greatest(largest(F.zip_with("a_low", "b_high", lambda s, t: s - t)), largest(F.zip_with("b_low", "a_high", lambda s, t: s - t)), F.lit(0.0))
    wide = F.least(F.array_min(F.zip_with("a_high", "b_high", lambda s, t: s + t)),
                   F.array_min(F.zip_with("a_low", "b_low", lambda s, t: F.lit(2 * np.pi) - s - t)), F.lit(np.pi))
    large, small = F.col("a_norm_high") * F.col("b_norm_high"), F.col("a_norm_low") * F.col("b_norm_low")
    slack = large * 1e-9 + 1
    met = met.withColumns({"_up": F.cos(gap), "_down": F.cos(wide)})
    return met.withColumns({"most": F.col("_up") * F.when(F.col("_up") >= 0, large).otherwise(small) + slack,
                            "least": F.col("_down") * F.when(F.col("_down") >= 0, small).otherwise(large) - slack})


def _filled(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, extra: str) -> DataFrame:
    """Pairs of blocks with their contents."""
    def content(df: DataFrame, side: str, *more: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "n", "raw", "ids", "norms", "angles", *more)])

    pairs = pairs.select("dim", "a_block", "b_block").repartition("a_block", "b_block")  # many tasks, whatever the joins below
    return (pairs.join(content(anchors, "a", extra), "a_block")
            .join(content(rows, "b"), "b_block").drop("a_block", "b_block"))


def _firsts(found: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(other))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ids(blocks_: DataFrame) -> DataFrame:
    """``block, place, anchor_id`` of every anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("ids").to_pylist()):
                ids = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids), dtype=np.int32)),
                                                  pa.array(ids)], ["block", "place", "anchor_id"])

    return blocks_.select("block", "ids").mapInArrow(run, "block bigint, place int, anchor_id bigint")


def _with_facts(anchors: DataFrame, places: DataFrame, facts: DataFrame, value: Column, name: str, *reach: Column) -> DataFrame:
    """Anchor blocks with one value per anchor, by place, and aggregates over the block; at most a block's anchors per group."""
    grouped = places.join(facts, "anchor_id", "left").groupBy("block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", value.alias("v")))), lambda s: s["v"]).alias(name), *reach)
    return anchors.join(grouped, "block")


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. ``anchor`` tells which rows are anchors.

    Positives are the best ``positives`` other rows of an anchor's label; for each the best ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` percent of the positive's. Other columns are not kept.
    """
    rows = vectors.select(plain(id_col).cast("bigint").alias("vec_id"), plain(label_col).cast("bigint").alias("label"),
                          F.coalesce(anchor, F.lit(False)).alias("anchor"), plain(vector_col).cast("array<double>").alias("v"))
    able = rows.where("vec_id is not null and label is not null and v is not null")
    sample: dict[int, list] = {}
    for r in able.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        x = np.array([np.nan if c is None else c for c in r["v"]], np.float64)
        if len(x) and np.isfinite(x).all() and x.any():
            sample.setdefault(len(x), []).append(x / np.abs(x).max())
    pivots = {dim: directions(np.stack(x)) for dim, x in sample.items()}
    placed, _ = materialise(able.mapInArrow(_placed(scale, pivots), _PLACED), "negatives")
    data = blocks(placed.drop("anchor"), ROWS)
    asked = blocks(placed.where("anchor").drop("anchor"), ANCHORS)
    places, _ = materialise(_ids(asked), "negatives")

    unknown = asked.withColumn("beat", F.lit(None).cast("array<bigint>"))
    seeds = _met(asked, data.where(F.col("n") > positives), True).groupBy("dim", "a_block").agg(
        F.max_by("b_block", F.struct("most", "b_block")).alias("b_block"))
    kind = "anchor_id bigint, positive_id bigint, positive_score bigint"
    seen = _filled(seeds, unknown, data, "beat").mapInArrow(_positives(positives), kind)
    to_beat = seen.groupBy("anchor_id").agg(F.when(F.count(F.lit(1)) >= positives, F.min("positive_score")).alias("beat"))
    lowest = F.min(F.coalesce("beat", F.lit(-(1 << 62)))).alias("reach_low")
    known, _ = materialise(_with_facts(asked, places, to_beat, F.col("beat"), "beat", lowest), "negatives")
    pairs = _met(known, data, True).where("most >= reach_low")
    found = _filled(pairs, known, data, "beat").mapInArrow(_positives(positives), kind)
    chosen, _ = materialise(_firsts(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "negatives")

    # A window in which no whole score lies is left to the test inside the blocks.
    floor = F.floor(F.col("positive_score") * (low / 100)) - 1
    ceiling = F.ceil(F.col("positive_score") * (high / 100)) + 1
    windows = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"),
                                              F.min(floor).alias("_low"), F.max(ceiling).alias("_high"))
    wanted, _ = materialise(_with_facts(asked, places, windows, F.col("positives"), "positives", F.min("_low").alias("reach_low"),
                                        F.max("_high").alias("reach_high")), "negatives")
    pairs = _met(wanted, data, False).where("most >= reach_low and least <= reach_high")
    kind = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = _filled(pairs, wanted, data, "positives").mapInArrow(_negatives(negatives, (low, high)), kind)
    return _firsts(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
