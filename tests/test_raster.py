"""Resampling and exact statistics against plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import scalar as sc
from terrane.operators import raster


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame([(r, c, None if (r * 7 + c) % 11 == 0 else float(r * r + 3 * c)) for r in range(9) for c in range(12)], "row long, col long, value double")


def test_resampled(spark, pixels):
    """A turned grid, with pixels without data, and centres on and beyond the edges."""
    held = {(r.row, r.col): r.value for r in pixels.collect()}
    source, target = raster.Grid(0.0, 0.0, 2.0, 3.0), raster.Grid(-3.0, -2.0, 1.1, 0.9, 0.3, -0.2)
    asked = spark.range(900).select(F.floor(F.col("id") / 30).alias("row"), (F.col("id") % 30).alias("col"))
    near = {(x.row, x.col): x.value for x in raster.resampled(pixels, source, asked, target, method="nearest").collect()}
    smooth = {(x.row, x.col): x.value for x in raster.resampled(pixels, source, asked, target).collect()}
    assert len(near) == len(smooth) == 900
    inside = 0
    for r, c in near:
        x, y = -3.0 + (c + 0.5) * 1.1 + (r + 0.5) * 0.3, -2.0 + (r + 0.5) * 0.9 - (c + 0.5) * 0.2
        fr, fc = y / 3, x / 2
        own = held.get((math.floor(fr), math.floor(fc)))
        assert near[r, c] == own
        weights = [((1 - abs(fr - 0.5 - i)) * (1 - abs(fc - 0.5 - j)), held[i, j]) for i in (math.floor(fr - 0.5), math.floor(fr - 0.5) + 1) for j in (math.floor(fc - 0.5), math.floor(fc - 0.5) + 1) if held.get((i, j)) is not None]
        if own is None:
            assert smooth[r, c] is None
        else:
            inside += 1
            assert smooth[r, c] == pytest.approx(sum(w * v for w, v in weights) / sum(w for w, _ in weights))
    assert inside > 100 and raster.resampled(pixels.limit(0), source, asked, target).filter("value IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        raster.resampled(pixels, source, asked, target, method="cubic")
    with pytest.raises(ValueError):
        raster.Grid(0.0, 0.0, 1.0, 2.0, 1.0, 2.0).index(F.lit(1.0), F.lit(1.0))


def test_reprojected(spark):
    """From degrees onto metres: a plane in degrees stays one, looked up by the inverse projection."""
    lon0, lat0, step = 80.2, 16.2, 0.01
    degrees = spark.range(3600).select(F.floor(F.col("id") / 60).alias("row"), (F.col("id") % 60).alias("col"))
    degrees = degrees.withColumn("value", lon0 + (F.col("col") + 0.5) * step + 10 * (lat0 + 0.6 - (F.col("row") + 0.5) * step))
    x, y = sc.utm(F.lit(80.5), F.lit(16.5), 44)
    corner = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    target = raster.Grid(corner.x, corner.y, 500.0, -500.0)
    asked = spark.range(400).select(F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"))
    got = raster.resampled(degrees, raster.Grid(lon0, lat0 + 0.6, step, -step), asked, target, lambda a, b: sc.from_utm(a, b, 44))
    px, py = target.place(F.col("row") + 0.5, F.col("col") + 0.5)
    lon, lat = sc.from_utm(px, py, 44)
    rows = got.select("value", (lon + 10 * lat).alias("want")).collect()
    assert all(r.value == pytest.approx(r.want, abs=1e-9) for r in rows) and len(rows) == 400


def test_from_utm(spark):
    """The inverse of the projection, to a tenth of a millimetre."""
    points = spark.createDataFrame([(lon, lat) for lon in (78.1, 80.0, 81.0, 83.9) for lat in (0.0, 8.5, 16.3, 35.0, 60.0)], "lon double, lat double")
    x, y = sc.utm(F.col("lon"), F.col("lat"), 44)
    lon, lat = sc.from_utm(x, y, 44)
    for r in points.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.a - r.lon) < 2e-9 and abs(r.b - r.lat) < 2e-9


def test_zonal_exact(spark, pixels):
    """Weights sum to a polygon's area, whatever its shape; inner pixels count whole."""
    grid = raster.Grid(0.0, 0.0, 10.0, 10.0)
    shapes = [(1, [[(12.0, 13.0), (85.0, 22.0), (60.0, 78.0)]]), (2, [[(0.0, 0.0), (120.0, 0.0), (120.0, 90.0), (0.0, 90.0)], [(31.0, 31.0), (59.0, 31.0), (59.0, 59.0), (31.0, 59.0)]]), (3, [[(500.0, 500.0), (510.0, 500.0), (500.0, 510.0)]])]
    polygons = spark.createDataFrame(shapes, "k long, rings array<array<struct<x:double,y:double>>>")
    got = {r.k: r for r in raster.zonal_exact(raster.pixel_rings(pixels, grid), polygons, "k", size=25.0).collect()}
    assert set(got) == {1, 2}
    assert got[1].covered == pytest.approx(abs((85 - 12) * (78 - 13) - (60 - 12) * (22 - 13)) / 2) and got[2].covered == pytest.approx(120 * 90 - 28 * 28)
    held = {(r.row, r.col): r.value for r in pixels.collect()}
    hole = lambda a, b: max(0.0, min(59.0, a + 10) - max(31.0, a)) * max(0.0, min(59.0, b + 10) - max(31.0, b))
    shares = {k: 1 - hole(k[1] * 10.0, k[0] * 10.0) / 100 for k in held}
    total = sum(shares[k] for k, v in held.items() if v is not None)
    assert got[2]["count"] == pytest.approx(total) and got[2].mean == pytest.approx(sum(shares[k] * v for k, v in held.items() if v is not None) / total)
