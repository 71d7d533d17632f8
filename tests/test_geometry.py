"""Distances, angles, polygons, warping."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.functions import dtw, geo, rings
from fairlead.operators import spatial


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_haversine_known_pair(spark):
    d = one(spark, geo.haversine(F.lit(51.95), F.lit(4.14), F.lit(53.54), F.lit(9.97)))
    assert 429_000 < d < 432_000
    assert d == pytest.approx(geo.haversine_number(51.95, 4.14, 53.54, 9.97))
    assert one(spark, geo.haversine(*[F.lit(10.0)] * 4)) == 0


@pytest.mark.parametrize("a,b,expected", [(40, 100, 70), (300, 80, 10), (80, 300, 10)])
def test_bearings_take_the_short_way(spark, a, b, expected):
    got = one(spark, geo.between_bearings(F.lit(float(a)), F.lit(float(b)), F.lit(0.5)))
    assert min(got, 360 - got) == pytest.approx(expected if expected else 0)


def test_bearing_error(spark):
    assert one(spark, geo.bearing_error(F.lit(333.0), F.lit(14.0))) == 41


def test_curvature_of_a_line_and_of_a_point(spark):
    path = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in pts])
    assert one(spark, geo.curvature(path([(0, 0), (0, 1), (0, 2), (0, 3)]))) == pytest.approx(1)
    assert one(spark, geo.curvature(path([(0, 0)]))) == 1
    assert one(spark, geo.curvature(path([(0, 0), (1, 0), (0, 0)]))) == 1
    assert one(spark, geo.curvature(path([(0, 0), (1, 0), (1, 1)]))) > 1.3


def slow_dtw(a, b):
    table = np.full((len(a) + 1, len(b) + 1), np.inf)
    table[0, 0] = 0
    for m in range(1, len(a) + 1):
        for n in range(1, len(b) + 1):
            before = [table[m - 1, n - 1], table[m - 2, n - 1] if m > 1 else np.inf, table[m - 1, n - 2] if n > 1 else np.inf]
            table[m, n] = math.dist(a[m - 1], b[n - 1]) + min(before)
    return table[-1, -1]


def test_dtw_equals_a_plain_table():
    draw = np.random.default_rng(5)
    pairs = [(draw.normal(size=(draw.integers(1, 9), 2)), draw.normal(size=(draw.integers(1, 9), 2))) for _ in range(120)]
    got = dtw.grouped([a for a, _ in pairs], [b for _, b in pairs], cells=64)
    assert np.allclose(got, [slow_dtw(a, b) for a, b in pairs], equal_nan=True)


def test_dtw_length_ratio():
    line = lambda n: np.zeros((n, 2))
    assert dtw.dtw(line(3), line(6)) == 0 and dtw.dtw(line(3), line(7)) == math.inf and dtw.dtw(line(0), line(3)) == math.inf


def test_polygon_edges_holes_and_nulls(spark):
    square = [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5)]]
    df = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 1.0), (2, 3.0, 1.0), (3, 2.0, 2.0), (4, 0.5, 1.0), (5, None, 1.0), (6, 0.2, 0.2)], "k int, lon double, lat double")
    assert sorted(r["k"] for r in spatial.inside(df, [square]).collect()) == [0, 3, 4, 6]
    assert sorted(r["k"] for r in spatial.outside(df, [square]).collect()) == [1, 2, 5]
    assert spatial.inside(df, None).count() == 7


def test_geojson_shapes():
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shape = {"type": "Polygon", "coordinates": [ring]}
    feature = {"type": "Feature", "geometry": shape}
    assert len(rings.polygons_of(shape)) == len(rings.polygons_of(feature)) == len(rings.polygons_of({"type": "FeatureCollection", "features": [feature]})) == 1
    assert rings.polygons_of(shape, bare=False) == []


def test_functions_in_sql(spark):
    geo.register(spark)
    assert spark.sql("SELECT haversine_m(51.95, 4.14, 53.54, 9.97)").first()[0] == pytest.approx(430255, abs=1)
    assert spark.sql("SELECT bearing_between(350, 20, 0.5)").first()[0] == 5
