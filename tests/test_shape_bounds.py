"""Shapes say what they leave out."""

import pytest
from pyspark.sql import functions as F

from signalmill.operators import metrics, shaping
from test_edges import points, S


def test_line_and_scatter_name_what_is_left_out(spark):
    df = spark.createDataFrame([(1_700_000_000_000 + k, *range(12)) for k in range(3)], "ts bigint, " + ", ".join(f"v{k} int" for k in range(12)))
    shape = shaping.line(df)
    assert shape.values == [f"v{k}" for k in range(8)] and shape.left_out == ["v8", "v9", "v10", "v11"]
    everything = shaping.line(df, most=None)
    assert len(everything.values) == 12 and everything.left_out == [] and everything.rows.count() == 3
    assert shaping.scatter(df).left_out == [f"v{k}" for k in range(4, 12)] and shaping.scatter(df, most=None).left_out == []
    assert shaping.line(df.limit(1)) is None
    assert shaping.line(df.withColumn("ts", F.when(F.col("ts") % 10 == 0, F.col("ts")))) is None  # one time only


def test_series_outside_the_keys_are_counted(spark):
    df = points(spark, *[{"ts_ns": k // 3 * S, "hist_count": 5, "value_double": float(k), "series_attributes": f'{{"h":"{k % 3}"}}'} for k in range(9)])
    name = df.select("metric_name").first()[0]
    keys = [r["series"] for r in metrics.series_points(df, name).select("series").distinct().orderBy("series").collect()]
    wide = metrics.series_wide(df, name, keys[:1], rest="others")
    assert [r["others"] for r in wide.collect()] == [2, 2, 2] and wide.columns == ["t_ms", keys[0], "others"]
    with pytest.raises(ValueError):
        metrics.series_wide(df, name, keys, rest=keys[0])
