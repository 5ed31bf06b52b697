"""The pipeline: each stage on its own input, with its decisions in effect."""

import corpus_pipeline
from conftest import SMALL
from test_text_operators import brute_quality


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 3000")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, SMALL).cache()
        after = {r["doc_id"] for r in kept.collect()}
        assert kept.columns == columns and after <= set(before)
        if name == "quality_rules":
            assert after == {i for i, t in before.items() if brute_quality(t)[-1]}
        if name == "ngram_join":
            texts = [before[i] for i in after]
            assert len(texts) == len(set(texts)) and set(texts) <= set(before.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in kept.collect()}


def test_run_on_the_small_tables(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_near_copies_go(spark):
    # A base of 200 words, and copies with a contiguous stretch of words changed: of 5-grams, 0.80 to 0.89 are shared; one is below.
    def copy(base, changed):
        return base[:50] + [f"{w}x" for w in base[50:50 + changed]] + base[50 + changed:]

    def similarity(a, b):
        a, b = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    rows, want = [], set()
    for k, changed in enumerate((8, 12, 15, 17, 18, 30)):
        base = [f"b{k}w{i}" for i in range(200)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(copy(base, changed)))]
        near = similarity(base, copy(base, changed))
        assert 0.8 <= near < 0.9 or changed in (18, 30)
        want |= {10 * k} | ({10 * k + 1} if near < 0.8 else set())
    got = corpus_pipeline.ngram_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert {r["doc_id"] for r in got.collect()} == want and {51} <= want
