"""Trace sessions across midnight."""

from pyspark.sql import Window, functions as F

from conftest import rows
from signalmill.operators import traces
from signalmill.sources import tables
from signalmill.streaming import keyed, live


def test_sessions_across_midnight_equal_the_summary(spark, small, tmp_path):
    ev = spark.read.parquet(f"{small}/events.parquet").orderBy("ts").limit(400)
    day = 86_400_000_000_000
    shift = F.lit(day // 1000).cast("bigint")
    # Spans every twenty minutes around midnight, in traces of eight.
    base = tables.spans_from(tables.keyed_events(ev)).withColumn("k", F.row_number().over(Window.orderBy("span_id")))
    at = F.lit(1_704_103_200_000_000_000) + F.col("k") * 1_200_000_000_000
    spans = base.withColumns({"trace_id": F.format_string("t%03d", F.floor(F.col("k") / 8)), "end_ns": at + F.col("end_ns") - F.col("start_ns"),
                              "start_ns": at}).drop("k")
    assert spans.groupBy("trace_id").agg(F.countDistinct(F.floor(F.col("start_ns") / day)).alias("d")).where("d > 1").count() >= 2
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    for lo, hi in (("t000", "t014"), ("t014", "t027"), ("t027", "t999")):
        spans.where((F.col("trace_id") >= lo) & (F.col("trace_id") < hi)).coalesce(1).write.mode("append").parquet(source)
    far = spans.limit(1).withColumns({"trace_id": F.lit("zz"), "start_ns": F.lit(2 * 10**18), "end_ns": F.lit(2 * 10**18)})

    def start():
        stream = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 1).parquet(source)
        live.write_versions(keyed.session_summaries(stream, "2 hours"), out, str(tmp_path / "mark"), mode="append").awaitTermination()

    start()
    far.coalesce(1).write.mode("append").parquet(source)  # time goes on, the open sessions close
    start()
    got = live.latest(spark, out, ["trace_id", "start_ns"])
    want = traces.trace_summary(spans)
    assert rows(got.select(*want.columns)) == rows(want)
