"""The skew-safe building blocks against their plain forms, with hot keys."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window as W, functions as F

from conftest import rows
from signalmill.operators.skew import balanced_edges, chunk_of, exact_quantiles, lookup, with_previous


def series(spark):
    """4 000 rows; a third share one key, some keys are NULL, times repeat."""
    return spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 17 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        (F.col("id") * 7919 % 2500).alias("ts"), F.col("id").alias("tie"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 97).alias("v"))


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_previous_equals_lag(spark, width):
    df = series(spark)
    got = with_previous(df, ["k"], ["ts", "tie"], ["v"], F.floor(F.col("ts") / width))
    want = df.withColumn("prev_v", F.lag("v").over(W.partitionBy("k").orderBy("ts", "tie")))
    assert rows(got) == rows(want)


def test_previous_with_balanced_edges(spark):
    df = series(spark).withColumn("ts", F.when(F.col("ts") < 2000, F.col("ts") % 5).otherwise(F.col("ts")))
    edges = balanced_edges(df, "ts", 16)
    assert 1 < len(edges) <= 15
    got = with_previous(df, ["k"], ["ts", "tie"], ["v"], chunk_of(F.col("ts"), edges))
    want = df.withColumn("prev_v", F.lag("v").over(W.partitionBy("k").orderBy("ts", "tie")))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("hot_rows", [1, 64, 1000, 10 ** 9])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_join(spark, hot_rows, how):
    left = series(spark)
    right = spark.range(45).select(F.when(F.col("id") == 44, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
                                   (F.col("id") * 10).alias("found"))
    got = lookup(left, right, ["k"], how, hot_rows)
    assert rows(got.select("k", "tie", "found")) == rows(left.join(right, "k", how).select("k", "tie", "found"))


def test_lookup_spreads_hot_and_null_keys(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").alias("k"), "id")
    right = spark.createDataFrame([("hot", 1)], "k string, found int")
    joined = lookup(left, right, ["k"], hot_rows=500)
    assert joined.where("found = 1").count() == 10_000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_slot" in plan


def reference_quantile(values, share, interpolate):
    ordered, n = sorted(values), len(values)
    if not interpolate:
        return ordered[max(math.ceil(round(share * n, 9)), 1) - 1]
    at = share * (n - 1)
    lo = math.floor(at)
    return ordered[lo] + (ordered[min(lo + 1, n - 1)] - ordered[lo]) * (at - lo)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60))
def test_quantiles_equal_sorting(spark, data):
    df = spark.createDataFrame(data, "g string, v double")
    for interpolate in (False, True):
        got = {r["g"]: (r["p50"], r["p95"]) for r in exact_quantiles(
            df, ["g"], "v", {"p50": "0.5", "p95": "0.95"}, interpolate).collect()}
        for g in {g for g, _ in data}:
            values = [v for k, v in data if k == g]
            for at, share in enumerate((0.5, 0.95)):
                assert got[g][at] == pytest.approx(reference_quantile(values, share, interpolate), rel=1e-9, abs=1e-9)


def test_quantile_of_a_hot_group(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 > 0, None)
                                    .otherwise(F.concat(F.lit("g"), F.col("id") % 100)).alias("g"),
                                    ((F.col("id") * 7919) % 10_007).cast("double").alias("v"))
    got = rows(exact_quantiles(df, ["g"], "v", {"q": "0.95"}))
    want = rows(df.groupBy("g").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("q")))
    assert got == want
