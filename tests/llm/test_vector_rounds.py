"""Chunks of vectors that meet in rounds."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_joins import roots

from signalmill.llm import neardup


def test_chunks_meet_once_in_rounds(spark):
    for n in (1, 2, 3, 4, 7):
        dealt, met = spark.range(n).select(F.col("id").cast("int").alias("chunk"), F.lit(n).alias("chunks")), Counter()
        for by in range(n // 2 + 1):
            tiles = defaultdict(list)
            rows = neardup.seats(dealt, by).collect()
            assert max(Counter(r["chunk"] for r in rows).values()) <= 2  # each row is shipped twice at most
            for r in rows:
                tiles[r["i"]].append((r["visits"], r["chunk"]))
            met.update(tuple(sorted(c for _, c in t)) for t in tiles.values())
            assert all(len(t) == (2 if by else 1) and sum(v for v, _ in t) == 1 for t in tiles.values())
        assert met == {**{(a,): 1 for a in range(n)}, **{(a, b): 1 for b in range(n) for a in range(b)}}


def test_far_steps_are_skipped_and_none_that_is_near():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    x = np.concatenate([c + rng.normal(size=(400, 6)) * 0.2 for c in centres])
    side = [(k, 1, v.astype(np.float32).tobytes() if k % 3 else v.tobytes()) for k, v in enumerate(x.astype(np.float32).astype(np.float64))]
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.93).sum(1) - 1
    got = {v: (n, low) for v, n, low in neardup._tile(side, side, 6, 0.93)}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, n in enumerate(want.tolist()) if n}
    cut = list(neardup._tile(side[:2000], side[2000:], 6, 0.93))
    low = roots(range(len(side)), [(a, r) for part in (side[:2000], side[2000:]) for a, _, r in neardup._tile(part, part, 6, 0.93)] + [(a, r) for a, _, r in cut])
    assert all(low[v] == low[r] for v, (_, r) in got.items()) and len(set(low.values())) == len({r for _, r in got.values()}) + len(side) - len(got)
    order = neardup.halved(y)
    at = list(range(0, len(y), 256))
    assert (neardup._apart(y[order], y[order], at, at) > 0.14).mean() > 0.2


def test_vectors_of_single_precision_travel_as_such(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.1, 0.2]), (3, [1e300, 1.0]), (4, [0.0, -0.0]), (5, [0.5, 0.25])]
    got = {r["vec_id"]: r["p"] for r in spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", neardup.placed(F.col("e")).alias("p")).collect()}
    assert [got[k] and len(got[k]["raw"]) for k in range(1, 6)] == [8, 16, 16, None, 8]
    assert got[1]["key"] == got[5]["key"] != got[2]["key"] and np.frombuffer(got[2]["raw"]).tolist() == [0.1, 0.2]
