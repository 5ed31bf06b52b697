"""Operators over whole tables against brute force."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from signalmill.llm import mixing, neardup, ngramjoin
from signalmill.llm.components import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(2000 - i, 3000) for i in range(40)]
    random = [tuple(map(int, rng.integers(0, 200, 2))) for _ in range(150)]
    edges = chain + star + random + chain[:3] + [(5, 5)]
    want = roots({n for e in edges for n in e}, edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 3]) for i in range(len(words) - 2)) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def test_ngram_join(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "TILE", 4)  # many tiles per group
    base = [f"w{i}" for i in range(80)]
    rows = [(1, "a b"), (2, "A  b"), (3, None), (4, ""), (5, "q"), (None, "a b")]
    rows += [(100 + k, " ".join(base[:k] + ["x"] + base[k + 1:])) for k in range(0, 80, 4)] + [(300, " ".join(base)), (301, " ".join(base).upper())]
    messy = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")
    for d in (messy, messy.limit(0), spark.read.parquet(f"{SMALL}/documents.parquet")):
        sets = {r["doc_id"]: sets_of(r["text"]) for r in d.collect() if r["doc_id"] is not None}
        ids = sorted(sets)
        links = [(a, b) for i, a in enumerate(ids) for b in ids[:i]
                 if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
        want, counts = roots(ids, links), defaultdict(int)
        for a, b in links:
            counts[a] += 1
            counts[b] += 1
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngramjoin.join(d).collect()}
        got.pop(None, None)
        assert got == {i: (len(sets[i]), want[i], counts[i]) for i in ids}


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(5, 7))
    rows = [(k, (base[k % 5] + rng.normal(size=7) * 0.2).tolist(), k % 2) for k in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 7, 1), (202, [float("nan")] * 7, 1), (203, rows[0][1], 0), (204, [2 * x for x in rows[0][1]], 0),
             (205, rows[0][1], None), (206, [1.0, None] + [0.0] * 5, 1), (207, [1.0], 1), (208, [3.0], 1), (209, [-1.0], 1), (210, [], 1),
             (211, [float("inf")] * 7, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    able = {i: (np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in able for b in able if b < a and able[a][1] == able[b][1] and len(able[a][0]) == len(able[b][0])
             and able[a][0] @ able[b][0] / np.linalg.norm(able[a][0]) / np.linalg.norm(able[b][0]) >= 0.93]
    want, counts = roots([r[0] for r in rows], links), defaultdict(int)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(d).collect()}
    assert got == {i: (counts[i], want[i], want[i] == i) for i in want}
    assert neardup.near_duplicates(d.limit(0)).count() == 0


def filled(sizes, weights, most=3):
    targets, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / weight > most * sizes[i]]
        for i in over or free:
            targets[i] = most * sizes[i] if over else rest * weights[i] / weight
        if not over:
            break
        free -= set(over)
        rest -= sum(targets[i] for i in over)
    return targets


def test_mix(spark):
    messy = spark.createDataFrame([(1, "a b c", "x"), (2, None, None), (3, "", "y"), (1, "a b c", "x"), (4, " q w\te ", None), (None, "z " * 500, "z")],
                                  "doc_id long, text string, source string")
    for d in (messy, messy.limit(0), spark.read.parquet(f"{SMALL}/documents.parquet")):
        rows = [r.asDict() for r in mixing.mix(d)[0].collect()]
        assert sorted(map(repr, rows)) == sorted(repr(r.asDict()) for r in mixing.mix(d)[0].collect())
        assert len(rows) == d.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
        names = sorted({r["source"] for r in rows if r["source"] is not None}) + [None] * any(r["source"] is None for r in rows)
        sizes = [sum(r["size"] for r in rows if r["source"] == s) for s in names]
        for s, size, target in zip(names, sizes, filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])):
            own = [r for r in rows if r["source"] == s]
            assert all(r["source_size"] == size and abs(r["target"] - target) < 1e-6 * (1 + target) for r in own)
            assert abs(sum(r["taken"] for r in own) - target) <= 0.05 * target + 64
        out = mixing.mixed(d)
        assert out.columns == d.columns
        out.collect()


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit("s"))).collect()]
        assert sorted(got) == list(range(n))


def on_circle(degrees):
    return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]


def test_near_vectors_in_large_cells(spark, monkeypatch):
    # Stars whose leaves have the smaller ids, and chains that end in one, in one label: leaves and middle are visitors of
    # different steps. Workers import the module, so that the step is as it is; the tile is the driver's.
    rng, at = np.random.default_rng(3), {}
    for k in range(200):
        middle, way = np.linalg.qr(rng.normal(size=(12, 2)))[0].T
        degrees = {1000 + k: 0, k: -15, 300 + k: 15} if k % 2 else {2000 + k: 0, 3000 + k: 15, 1500 + k: 30, 500 + k: 45}
        at |= {i: np.cos(np.radians(d)) * middle + np.sin(np.radians(d)) * way for i, d in degrees.items()}
    ids = rng.permutation(sorted(at))
    x = np.stack([at[i] for i in ids])
    links = [(int(ids[a]), int(ids[b])) for a, b in np.argwhere(x @ x.T >= 0.93) if a < b]
    want, counts = roots(ids.tolist(), links), defaultdict(int)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    d = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int")
    for tile in (neardup.TILE, 100):
        monkeypatch.setattr(neardup, "TILE", tile)
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(d).collect()}
        assert got == {i: (counts[i], want[i], want[i] == i) for i in want}


def test_tile_yields_every_linked_vector(monkeypatch):
    # 7 is linked to 1 and 5, these two are not: what the visitors 7 and 5 give must join all three.
    monkeypatch.setattr(neardup, "_STEP", 1)
    raw = {i: np.array(on_circle(at)).tobytes() for i, at in {7: 0, 1: -15, 5: 15}.items()}
    side = [(i, 1, raw[i]) for i in (7, 1, 5)]
    for visitors, residents in ((side, side), (side[:1], side[1:])):
        edges = [(v, low) for v, _, low in neardup._tile(visitors, residents, 0, 0.93)]
        assert set(roots([7, 1, 5], edges).values()) == {1}


def test_linked_sets_share_a_prefix():
    rng = np.random.default_rng(5)
    for percent, (x, y, both) in ((80, (5, 4, 4)), (80, (9, 9, 8)), (80, (15, 12, 12)), (90, (10, 9, 9)), (90, (19, 19, 18)), (100, (7, 7, 7))):
        for _ in range(500):
            g = rng.integers(0, 2**64, x + y - both, np.uint64)
            a, b = np.unique(g[:x]), np.unique(g[x - both:])
            assert len(np.intersect1d(a, b)) == both and 100 * both >= percent * len(g)
            hashes = np.unique(rng.choice(g, len(g) // 2))
            rank = rng.integers(1, 255, len(hashes)).astype(np.uint8)
            assert len(np.intersect1d(ngramjoin.prefix(a, percent, hashes, rank), ngramjoin.prefix(b, percent, hashes, rank)))
    assert len(ngramjoin.prefix(np.empty(0, np.uint64), 90, hashes, rank)) == 0


def test_product_against_plain_overlaps(monkeypatch):
    monkeypatch.setattr(ngramjoin, "SLICE", 7)  # many slices, in which pairs are discarded
    rng = np.random.default_rng(11)
    for percent in (50, 80, 90):
        pool = [rng.integers(0, 2**64, n, np.uint64) for n in (30, 31, 60, 100)]
        made = [np.unique(np.concatenate([p[rng.random(len(p)) < 0.95], rng.integers(0, 2**64, rng.integers(0, 6), np.uint64)]))
                for p in pool for _ in range(9)] + [np.array([5], np.uint64)]
        left, right = made[::2], made[1::2]
        for x, y in ((left, right), (left, left), (left[:1], right)):
            want = np.array([[100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for b in y] for a in x])
            assert (ngramjoin.linked_pairs(x, y, percent) == want).all()


def copies(seed):
    """Documents of several lengths with copies of every degree, a large group of near copies, and lines that all share."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 4000)}"
    shared, rows = [word() for _ in range(40)], []
    for size in (1, 2, 4, 6, 10, 25, 60, 150, 400):
        for _ in range(4):
            base = [word() for _ in range(size)] + (shared if rng.random() < 0.5 else [])
            for changes in (0, 1, 1, 2, size // 30, size // 12):
                new = list(base)
                for at in rng.integers(0, len(new), changes):
                    new[at] = word()
                rows.append(" ".join(new))
    hot = [word() for _ in range(120)]
    rows += [" ".join([word()] + hot[k % 2:]) for k in range(150)]
    rows += [" ".join(hot * 400 + [word()]) for _ in range(2)]  # very long
    return [(k, t) for k, t in enumerate(rng.permutation(rows).tolist())]


def plain_join(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = text.encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(max(len(w) - n + 1, 1))) if w else frozenset()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    counts = defaultdict(int)
    for e in links:
        for x in e:
            counts[x] += 1
    low = roots(ids, links)
    return {(i, len(sets[i]), low[i], counts[i]) for i in ids}


def test_rows_of_one_ngram_are_connected(monkeypatch):
    rng = np.random.default_rng(6)
    for percent in (80, 90):
        base = rng.integers(0, 2**64, 400, np.uint64)
        sets = {k: np.unique(np.concatenate([base[k % 7:], rng.integers(0, 2**64, 3, np.uint64)])) for k in range(1, 40)}
        sets |= {100 + k: np.unique(rng.integers(0, 2**64, 400, np.uint64)) for k in range(40)}
        rows = sorted((g, len(s), k) for k, s in sets.items() for g in (5, 9))
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[2] for r in part]), pa.array([r[1] for r in part]),
                                               pa.array([ngramjoin.sketch(sets[r[2]]) for r in part], pa.binary())], ["gram", "rep", "size", "sketch"])
                   for part in (rows[:30], rows[30:31], rows[31:])]
        for hot in (1024, 4):
            monkeypatch.setattr(ngramjoin, "HOT", hot)
            edges = [e for b in ngramjoin._connected(percent)(iter(batches)) for e in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
            found = roots(sets, edges)
            assert all(found[k] == 1 for k in range(1, 40))
            assert hot < 1024 or all(found[k] == k for k in range(100, 140))


@pytest.mark.parametrize("seed, n, percent, tile", [(1, 3, 90, 1024), (2, 5, 80, 16)])
def test_join_of_copies(spark, monkeypatch, seed, n, percent, tile):
    monkeypatch.setattr(ngramjoin, "TILE", tile)
    if tile < 1024:
        monkeypatch.setattr(ngramjoin, "TILE_BYTES", 20_000)
    rows = copies(seed)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, size int, grp int, slot int").repartition(5)
    got = ngramjoin.join(docs, n=n, threshold=percent / 100).collect()
    assert {tuple(r) for r in got} == plain_join(rows, n, percent) and len(got) == len(rows)


def test_repeated_rows_are_one_document(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base))] * 3 + [(2, " ".join(base[:-1] + ["x"]))] * 2 + [(3, " ".join(base))]
    got = {(r["doc_id"], r["component_id"], r["n_links"]) for r in ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 1, 2)}
