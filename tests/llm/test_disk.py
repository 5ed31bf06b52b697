"""What the joins leave on disk, and how much they ship."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_joins import copies, plain_join, roots

from signalmill import session
from signalmill.llm import ngramjoin


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {blocks.apply(k).name() for k in range(blocks.size()) if blocks.apply(k).isShuffle()}


def test_shuffles_go_once_their_table_is_written(spark):
    was, setting = shuffle_files(spark), spark.conf.get(session.SHUFFLES_GO, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k")
    got, seen = session.materialise(df, "test", n=F.count(F.lit(1)))
    until = time.time() + 5  # they are removed by messages
    while shuffle_files(spark) - was and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - was and spark.conf.get(session.SHUFFLES_GO, None) == setting
    assert seen["n"] == 7 and {r["count"] for r in got.collect()} == {142, 143}
    assert df.count() == 7  # it can be run again


def edges_of(sets, percent):
    batch = pa.RecordBatch.from_arrays([pa.array([7] * len(sets)), pa.array(range(len(sets))), pa.array([len(s) for s in sets]),
                                        pa.array([ngramjoin.sketch(s) for s in sets], pa.binary())], ["gram", "rep", "size", "sketch"])
    return [e for b in ngramjoin._connected(percent)(iter([batch])) for e in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]


@pytest.mark.parametrize("size, rows", [(8, 60), (36, 60), (150, 60), (36, 1500)])
def test_short_sets_of_one_ngram_are_not_connected(size, rows):
    rng = np.random.default_rng(size)
    shared = rng.integers(0, 2**64, 1, np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 2**64, size - 1, np.uint64)])) for _ in range(rows)]
    near = Counter(roots(range(rows), edges_of(sets, 80)).values())
    assert len(near) > 0.9 * rows  # of 1500 rows, some pairs are near by chance
    # A copy that shares 34 of 36 n-grams, and one that shares 8 of 9, are connected.
    other = np.unique(np.concatenate([sets[0][:-1], rng.integers(0, 2**64, 1, np.uint64)]))
    assert edges_of(sorted([sets[0], other], key=len), 80 if size > 8 else 75)


def test_sketches_of_linked_sets_differ_by_chance_only():
    rng = np.random.default_rng(8)
    for size in (10, 40, 5000):
        differ = []
        for _ in range(300):
            g = rng.integers(0, 2**64, size, np.uint64)
            a, b = (np.frombuffer(ngramjoin.sketch(np.unique(x)), np.uint64) for x in (g[:-size // 10], g[size // 10:]))
            differ.append(int(np.bitwise_count(a ^ b).sum()))
        assert abs(np.mean(differ) - 12.8) < 1 and np.var(differ) < 1.5 * 128 * 0.1 * 0.9 and max(differ) <= ngramjoin.may_differ(80)


def test_hot_ngram_in_parts(monkeypatch):
    monkeypatch.setattr(ngramjoin, "PART", 8)
    rng = np.random.default_rng(9)
    bases = [rng.integers(0, 2**64, 200, np.uint64) for _ in range(5)]
    sets = sorted((np.unique(np.concatenate([bases[k % 5][k % 7:], rng.integers(0, 2**64, 3, np.uint64)])) for k in range(60)), key=len)
    of = [int(np.argmax([len(np.intersect1d(s, b)) for b in bases])) for s in sets]
    found = roots(range(60), edges_of(sets, 80))
    assert all((found[a] == found[b]) == (of[a] == of[b]) for a in range(60) for b in range(60))


def test_tiles_in_rounds(spark, monkeypatch):
    rows, seen, once = copies(3), [], ngramjoin._linked
    monkeypatch.setattr(ngramjoin, "TILE", 16)
    monkeypatch.setattr(ngramjoin, "ROUND", 1)
    monkeypatch.setattr(ngramjoin, "_linked", lambda texts, tiles, n, percent: seen.append(tiles.agg(F.sum("size")).first()[0]) or once(texts, tiles, n, percent))
    docs = spark.createDataFrame(rows + [(None, rows[0][1])], "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in ngramjoin.join(docs, n=5, threshold=0.8).where("doc_id is not null").collect()}
    assert got == plain_join(rows, 5, 80) and len(seen) > 2
    assert max(x or 0 for x in seen) <= sum(len(t.split()) for _, t in rows)


def test_pipeline_join_leaves_no_shuffles(spark):
    import corpus_pipeline

    was = shuffle_files(spark)
    kept = corpus_pipeline.ngram_join(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "")
    until = time.time() + 5
    while shuffle_files(spark) - was and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - was
    assert 0 < kept.count() < 200
