"""Trends against published and directly computed values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrain.operators import trends
from tests.golden import AGES, MALE, MALE_SMOOTH


@pytest.fixture(scope="module")
def series(spark):
    rows = [(None if i % 2 else "g", int(a), y) for i in (0, 1) for a, y in zip(AGES, MALE)]
    return spark.createDataFrame(rows, "grp string, age int, y double")


def test_loess_equals_published_smooth(series):
    got = trends.loess_trend(series, ["grp"], "age", "y").orderBy("age").toPandas()
    for _, part in got.groupby("grp", dropna=False):
        assert len(part) == 67
        np.testing.assert_allclose(part.trend, MALE_SMOOTH, rtol=1e-6)


def test_loess_keeps_points_without_value(spark):
    rows = [("g", a, y) for a, y in zip(AGES, MALE)] + [("g", 90, None)]
    df = spark.createDataFrame(rows, "grp string, age int, y double")
    got = {r.age: r.trend for r in trends.loess_trend(df, ["grp"], "age", "y").collect()}
    assert got[90] is None
    assert got[40] == pytest.approx(MALE_SMOOTH[25], rel=1e-6)


def test_loess_rejects_repeated_x(spark):
    df = spark.createDataFrame([("g", 1, 1.0), ("g", 1, 2.0), ("g", 2, 2.0)], "grp string, x int, y double")
    with pytest.raises(Exception, match="one point per group"):
        trends.loess_trend(df, ["grp"], "x", "y").collect()
    with pytest.raises(ValueError):
        trends.loess_trend(df, ["grp"], "x", "y", span=1.5)


def test_cubic_and_spline(series):
    x, y = np.array(AGES, float), np.array(MALE)
    u = (x - 50) / 35
    cubic = np.polyval(np.polyfit(u, y, 3), u)
    design = np.c_[np.ones_like(u), u, u**2, u**3, np.maximum(u - np.median(u), 0) ** 3]
    spline = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    for function, want in ((trends.cubic_trend, cubic), (trends.spline_trend, spline)):
        got = function(series.filter("grp is not null"), ["grp"], "age", "y").orderBy("age").toPandas()
        np.testing.assert_allclose(got.trend, want, rtol=1e-9)


def test_cubic_on_two_points_is_a_line(spark):
    df = spark.createDataFrame([("g", 1, 2.0), ("g", 3, 6.0)], "grp string, x int, y double")
    got = {r.x: r.trend for r in trends.cubic_trend(df, ["grp"], "x", "y").collect()}
    assert got == pytest.approx({1: 2.0, 3: 6.0})
    one = spark.createDataFrame([("g", 1, 2.0)], "grp string, x int, y double")
    assert trends.cubic_trend(one, ["grp"], "x", "y").first().trend == pytest.approx(2.0)


def test_vertices_do_not_grow_with_the_data(spark):
    for n in (67, 1000, 5000):
        df = spark.range(n).select(F.struct(F.lit(0).alias("_"), F.lit("g").alias("grp")).alias("_key"),
                                   F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
        assert trends._interpolation_vertices(df, 0.75).count() <= 9
