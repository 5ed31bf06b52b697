"""Streams equal their batch operators, also over several micro-batches and restarts."""

from pyspark.sql import functions as F

from conftest import rows
from signalmill.operators import counters, red, traces
from signalmill.sources import feed, store, tables
from signalmill.sources.envelope import flatten_metrics
from signalmill.streaming import ingest, live
from test_edges import points, S


def split_events(spark, small, path, parts=3):
    """The events table as several files in time order."""
    ev = spark.read.parquet(f"{small}/events.parquet")
    cuts = ev.agg(F.percentile_approx("event_id", [k / parts for k in range(1, parts)])).first()[0]
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = ev
        if lo is not None:
            part = part.where(F.col("event_id") > lo)
        if hi is not None:
            part = part.where(F.col("event_id") <= hi)
        part.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    raw = spark.readStream.schema(tables.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return tables.keyed_events(raw)


def test_red_over_micro_batches(spark, small, tmp_path):
    split_events(spark, small, str(tmp_path / "ev"))
    changes = live.span_red(tables.spans_from(stream(spark, str(tmp_path / "ev"))), late="60 days")
    live.write_versions(changes, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = live.latest(spark, str(tmp_path / "out"), ["ts"])
    spans = tables.spans(spark, small)
    want = red.span_rate(spans).join(red.span_error_share(spans), "ts")
    assert rows(got.select("ts", "rps", "err_pct")) == rows(want.select("ts", "rps", "err_pct"))


def test_traces_over_micro_batches(spark, small, tmp_path):
    split_events(spark, small, str(tmp_path / "ev"))
    parts = live.partial_summaries(tables.spans_from(stream(spark, str(tmp_path / "ev"))), keep="6 hours", late="60 days")
    live.write_versions(parts, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = live.merge_summaries(live.latest(spark, str(tmp_path / "out"), ["trace_id", "window_start"]))
    assert rows(got) == rows(traces.trace_summary(tables.spans(spark, small)))


def test_increase_over_micro_batches_and_restart(spark, tmp_path):
    given = [{"ts_ns": t * 120 * S, "hist_count": (t * 5) % 37 + t, "series_attributes": f'{{"name":"{t % 3}"}}'} for t in range(60)]
    source, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    columns = ["service_name", "resource_attributes", "series_attributes", "ts_ns", "hist_count"]
    all_points = points(spark, *given).select(*columns)

    def feed_and_run(lo, hi):
        for k in range(lo, hi, 10):
            points(spark, *given[k:k + 10]).select(*columns).coalesce(1).write.mode("append").parquet(source)
        lines = spark.readStream.schema(all_points.schema).option("maxFilesPerTrigger", 1).parquet(source)
        live.start_increases(lines, out, mark).awaitTermination()

    feed_and_run(0, 30)
    feed_and_run(30, 60)
    got = spark.read.parquet(f"{out}/rows").select(*columns, "inc_hist_count")
    assert rows(got) == rows(counters.counter_increase(all_points))


def test_ingest_restart_adds_only_new_requests(spark, small, tmp_path):
    ev = tables.events(spark, small)
    requests = feed.metric_requests(ev)
    source, root, mark = (str(tmp_path / n) for n in ("src", "root", "mark"))
    requests.where(F.length("value") % 2 == 0).coalesce(2).write.mode("append").text(source)
    run = lambda: ingest.start_ingest(spark.readStream.option("maxFilesPerTrigger", 1).text(source), root, "metric_points", mark).awaitTermination()
    run()
    requests.where(F.length("value") % 2 == 1).coalesce(1).write.mode("append").text(source)
    run()
    got = store.read_table(spark, root, "metric_points").drop("event_date")
    assert rows(got) == rows(flatten_metrics(requests))


def test_store_is_empty_after_reset(spark, small, tmp_path):
    root = str(tmp_path / "root")
    store.append(tables.log_records(spark, small), root, "log_records")
    assert store.read_table(spark, root, "log_records").count() > 0
    store.reset(spark, root)
    assert all(df.isEmpty() for df in store.read_tables(spark, root).values())
    store.append(tables.log_records(spark, small).limit(3), root, "log_records", balance=False)
    assert store.read_table(spark, root, "log_records").count() == 3
