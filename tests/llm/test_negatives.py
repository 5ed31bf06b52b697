"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import negatives
from signalmill.llm.queries import op13_hard_negatives

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, every=2, k=5, m=3, low=50, high=95):
    able = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        able[i] = (label, [math.floor(256 * float(np.float32(x))) for x in v])
    out = set()
    for a, (label, x) in able.items():
        if a % every:
            continue
        scores = {b: sum(p * q for p, q in zip(x, y)) for b, (_, y) in able.items() if b != a and len(y) == len(x)}
        order = lambda ids: sorted(ids, key=lambda b: (-scores[b], b))
        for p in order(b for b in scores if able[b][0] == label)[:k]:
            near = order(b for b in scores if able[b][0] != label and low * scores[p] <= 100 * scores[b] <= high * scores[p])[:m]
            out |= {(a, p, r, n, scores[p], scores[n]) for r, n in enumerate(near, 1)}
    return out


def clustered(n, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim)) * 3
    return [(i, (centres[i % 7] + rng.normal(size=dim) * 0.4).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def mined(spark, rows, **more):
    docs = spark.createDataFrame(rows, KIND).withColumns({"block": F.lit(1), "score": F.lit("x")}).repartition(4)
    got = [tuple(r) for r in negatives.mine(docs, F.col("vec_id") % 2 == 0, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_small_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    rows = clustered(200)
    rows += [(1000 + i, rows[3][1], 1) for i in range(40)]  # copies, tied
    rows += [rows[0], rows[0], (2000, None, 1), (2002, [], 1), (2004, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2006, [float("nan")] * 6, 1),
             (2008, [float("inf")] + [0.0] * 5, 2), (2010, [0.0] * 6, 2), (2012, [1.0] * 6, None), (None, [1.0] * 6, 2),
             (2014, [1.0, 2.0], 1), (2016, [1.0, 2.0], 1), (2018, [1.5, 1.0], 2), (2020, [-1.0, 0.5, 0.0, 0.0, 0.0, 9.0], 3)]
    want = brute(rows)
    assert mined(spark, rows) == want and len(want) > 500


@pytest.mark.parametrize("size", [3.0, 30_000.0])
def test_large_components_are_exact(spark, size):
    rows = [(i, [x * size for x in v], label) for i, v, label in clustered(60, seed=5)]
    assert mined(spark, rows, positives=2, negatives=4) == brute(rows, k=2, m=4)


def test_empty_table(spark):
    assert mined(spark, []) == set()


def test_planted_labels_of_the_query(spark, tmp_path):
    rows = clustered(120, seed=9)
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "embeddings.parquet"))
    changed = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert {tuple(r) for r in op13_hard_negatives(spark, str(tmp_path)).collect()} == brute(changed, every=50)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    rows = np.array([v for _, v, _ in clustered(3000, dim=16)])
    x = np.floor(256 * rows)
    norm = np.linalg.norm(x, axis=1)
    angles = negatives.angles_to(x, norm, negatives.directions(rows[:2000])).astype(float)
    a, b = rng.integers(0, len(x), (2, 20_000))
    slack = negatives.SLACK
    least, most = negatives.bounds(angles[a] - slack, angles[a] + slack, angles[b] - slack, angles[b] + slack,
                                   (norm[a], norm[a]), (norm[b], norm[b]))
    exact = (x[a] * x[b]).sum(1)
    assert (least <= exact).all() and (exact <= most).all()
    # Clusters: few pairs of different clusters can reach the scores inside one.
    other = a % 7 != b % 7
    assert (most[other] < 0.8 * np.median(exact[~other])).mean() > 0.6
