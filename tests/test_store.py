"""The store: manifests, file indexes, compaction, reset, old stores."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from signalmill.functions import variants
from signalmill.operators import catalog, filters, stored, traces
from signalmill.sources import fileindex, manifest, store, tables
from signalmill.sources.manifest import Entry


@pytest.fixture(scope="module")
def root(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("indexed"))
    store.append_all(dict(tables.signal_tables(spark, small)), path, batch="all")
    return path


def files_in(df):
    return set(df.inputFiles())


def test_trace_lookup_reads_the_matching_files_only(spark, root):
    spans = store.read_table(spark, root, "spans")
    for trace, in spans.select("trace_id").distinct().orderBy("trace_id").limit(3).collect():
        found = store.read_matching(spark, root, "spans", {"trace_id": trace})
        assert len(files_in(found)) <= 3 < len(files_in(spans))
        assert "PartitionFilters" in found._jdf.queryExecution().executedPlan().toString()
        got, want = stored.trace_detail(spark, root, trace), traces.trace_detail(spans, trace)
        assert rows(got.spans) == rows(want.spans) and rows(got.summary) == rows(want.summary)
    nothing = stored.trace_detail(spark, root, "no such trace")
    assert nothing.spans.isEmpty() and nothing.summary.isEmpty()


def test_search_finds_what_ilike_finds(spark, root):
    logs = store.read_table(spark, root, "log_records")
    for q in ("USER 7", "purchase%1", "er", "no such words", "a_b", "'", "%"):
        assert rows(stored.search_logs(spark, root, q)) == rows(filters.filter_logs(logs, q=q))
    assert not files_in(store.read_matching(spark, root, "log_records", q="no such words"))
    spans = store.read_table(spark, root, "spans")
    assert rows(stored.search_spans(spark, root, "SIGN")) == rows(filters.filter_spans(spans, q="SIGN"))


def test_trigrams(spark):
    df = spark.createDataFrame([("Straße ÄB",), ("ab",), ("",), (None,), ("aaaa",)], "t string")
    got = [r[0] for r in df.select(fileindex.trigrams(F.col("t"))).collect()]
    assert got == [["str", "tra", "raß", "aße", "ße ", "e ä", " äb"], [], [], None, ["aaa"]]
    assert fileindex.fragments("ab%cde_fgh") == ["cde", "fgh"]


def test_totals_from_sketches(spark, root):
    got, want = stored.approximate_stats(spark, root).first(), catalog.stats(store.read_tables(spark, root)).first()
    for c in ("spans", "logs", "metric_points", "earliest_ns", "latest_ns"):
        assert got[c] == want[c]
    assert all(abs(got[c] - want[c]) <= 0.05 * want[c] for c in ("traces", "metrics", "services"))
    assert {r["services"] for r in stored.daily_services(spark, root).collect()} <= set(range(1, 6))


def test_a_batch_is_there_whole_or_not_at_all(spark, small, tmp_path, monkeypatch):
    path, logs, spans = str(tmp_path), tables.log_records(spark, small).limit(40).cache(), tables.spans(spark, small).limit(30).cache()
    store.append_all({"log_records": logs, "spans": spans}, path, batch="one")
    seen = []
    write = store._write

    def watched(df, root, table, *more, **named):
        made = write(df, root, table, *more, **named)
        seen.append({t: store.read_table(spark, path, t).count() for t in ("log_records", "spans")})
        return made

    monkeypatch.setattr(store, "_write", watched)
    store.append_all({"log_records": logs, "spans": spans}, path, batch="two")
    assert seen == [{"log_records": 40, "spans": 30}] * 2  # between its two tables a batch is not seen
    assert store.read_table(spark, path, "spans").count() == 60
    reader = store.read_table(spark, path, "spans")
    assert store.compact(spark, path, "spans") == 2 and reader.count() == 60
    store.append(spans, path, "spans", batch="two")  # folded: known to be there
    assert store.read_table(spark, path, "spans").count() == 60
    store.reset(spark, path)
    assert reader.count() == 60 and all(df.isEmpty() for df in store.read_tables(spark, path).values())
    assert store.vacuum(spark, path) == [] and len(store.vacuum(spark, path, older_than_s=-5)) >= 5


def test_manifests(spark, tmp_path):
    path, made = str(tmp_path), []

    def slow(entries):
        if not made:  # another writer is faster
            made.append(1)
            manifest.commit(spark, path, lambda e: [*e, Entry("t", "other", "t/other")])
        return [*entries, Entry("t", "mine", "t/mine")]

    assert [e.batch for e in manifest.commit(spark, path, slow).entries] == ["other", "mine"]
    assert manifest.snapshot(spark, path).version == 1
    folded, names = manifest.fold_names([Entry("t", "s-a-3", "x"), Entry("t", "s-a-11", "x"), Entry("t", "b-zx", "x"),
                                         Entry("t", "c-qx", "x", folded={"s-b-": 4}, names=("b-yx",))])
    made = Entry("t", "c-x", "x", folded=folded, names=names)
    assert all(made.stands_for(n) for n in ("s-a-11", "s-a-0", "s-b-4", "b-zx", "b-yx")) and not any(
        made.stands_for(n) for n in ("s-a-12", "s-c-1", "b-z"))


def test_a_store_without_manifest_is_taken_over(spark, small, tmp_path):
    path, logs = str(tmp_path), tables.log_records(spark, small).limit(20)
    store.with_layout(logs, "log_records").write.partitionBy("event_date").parquet(f"{path}/log_records/batch=old")
    assert store.read_table(spark, path, "log_records").count() == 20
    store.append(logs, path, "log_records")
    assert store.read_table(spark, path, "log_records").count() == 40
    assert stored.search_logs(spark, path, "user").count() == 40


def test_values_of_json_text(spark):
    texts = ['{"a.b":{"c":[1,"x"]},"it\'s":true}', '"text"', "12.5", "true", "null", "[1]", "no json", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(variants.parse_or_keep(F.col("t")).alias("v"))
    got = df.select(variants.kind(F.col("v")), variants.text_at(F.col("v"))).collect()
    assert [r[0] for r in got] == ["object", "string", "number", "boolean", "null", "array", "string", "string", None]
    assert [r[1] for r in got][1:3] == ["text", "12.5"] and got[6][1] == "no json" and got[7][1] == ""
    inner = df.select(variants.text_at(F.col("v"), "a.b", "c", 1), variants.text_at(F.col("v"), "it's")).first()
    assert tuple(inner) == ("x", "true")
