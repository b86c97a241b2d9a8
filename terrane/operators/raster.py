"""Rasters as tables of pixels: resampling onto another grid, and exact statistics of polygons.

A raster is (row, col, value) with a null value where there is no data, and an affine grid: the place of the upper left
corner of pixel (0, 0) and the steps of a column and a row along x and y.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.cover import overlay_area


@dataclass(frozen=True)
class Grid:
    """x = x0 + col * dx + row * rx, y = y0 + row * dy + col * ry, at a pixel's upper left corner."""

    x0: float
    y0: float
    dx: float
    dy: float
    rx: float = 0.0
    ry: float = 0.0

    def place(self, row: Column, col: Column) -> tuple[Column, Column]:
        return self.x0 + col * self.dx + row * self.rx, self.y0 + row * self.dy + col * self.ry

    def index(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col), fractional, of a place."""
        det = self.dx * self.dy - self.rx * self.ry
        if det == 0:
            raise ValueError("the grid's steps are parallel")
        u, v = x - self.x0, y - self.y0
        return (v * self.dx - u * self.ry) / det, (u * self.dy - v * self.rx) / det


def resampled(pixels: DataFrame, source: Grid, target_pixels: DataFrame, target: Grid, inverse: Callable[[Column, Column], tuple[Column, Column]] | None = None, method: str = "bilinear", keep: tuple[str, ...] = ()) -> DataFrame:
    """target_pixels (row, col, keep...) with value, resampled from pixels (row, col, value).

    Each target pixel's centre is mapped back by inverse (from the target's reference system to the source's, as
    Columns; None: the same) and looked up: nearest takes the pixel that holds it, bilinear the four around it, with
    the weights of those that have data shared out. A centre outside of the source, or whose own pixel has no data, has
    no data. Both ways a target row meets one source row: pixels go to the four squares of centres that they border.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"unknown method {method}")
    x, y = target.place(F.col("row") + 0.5, F.col("col") + 0.5)
    x, y = inverse(x, y) if inverse else (x, y)
    row, col = source.index(x, y)
    asked = target_pixels.select("row", "col", *keep, row.alias("_r"), col.alias("_c"))
    if method == "nearest":
        looked = asked.withColumn("_row", F.floor("_r").cast("long")).withColumn("_col", F.floor("_c").cast("long"))
        held = pixels.select(F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col"), F.col("value").cast("double").alias("value"))
        return looked.join(held, ["_row", "_col"], "left").select("row", "col", *keep, "value")
    corners = F.explode(F.array(*[F.struct((F.col("row").cast("long") - i).alias("_row"), (F.col("col").cast("long") - j).alias("_col"), F.lit(2 * i + j).alias("k")) for i in (0, 1) for j in (0, 1)])).alias("_q")
    quads = pixels.select(corners, F.col("value").cast("double").alias("value")).select("_q.*", "value")
    quads = quads.groupBy("_row", "_col").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"_v{k}") for k in range(4)])
    # centres of pixels are half a step in
    asked = asked.withColumn("_row", F.floor(F.col("_r") - 0.5).cast("long")).withColumn("_col", F.floor(F.col("_c") - 0.5).cast("long"))
    fr, fc = F.col("_r") - 0.5 - F.col("_row"), F.col("_c") - 0.5 - F.col("_col")
    weights = [(1 - fr if i == 0 else fr) * (1 - fc if j == 0 else fc) for i in (0, 1) for j in (0, 1)]
    known = [F.col(f"_v{k}").isNotNull() for k in range(4)]
    total = sum((F.when(known[k], weights[k]).otherwise(0.0) for k in range(4)), F.lit(0.0))
    value = sum((F.coalesce(F.col(f"_v{k}") * weights[k], F.lit(0.0)) for k in range(4)), F.lit(0.0))
    own = F.when(fr < 0.5, F.when(fc < 0.5, F.col("_v0")).otherwise(F.col("_v1"))).otherwise(F.when(fc < 0.5, F.col("_v2")).otherwise(F.col("_v3")))
    out = asked.join(quads, ["_row", "_col"], "left")
    return out.select("row", "col", *keep, F.when(own.isNotNull() & (total > 0), value / F.when(total > 0, total)).alias("value"))


def pixel_rings(pixels: DataFrame, grid: Grid) -> DataFrame:
    """pixels with pixel, an id, and ring, its four corners."""
    corners = []
    for i, j in ((0, 0), (0, 1), (1, 1), (1, 0)):
        x, y = grid.place(F.col("row") + i, F.col("col") + j)
        corners.append(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return pixels.withColumn("pixel", F.struct("row", "col")).withColumn("ring", F.array(*corners))


def zonal_exact(pixels: DataFrame, polygons: DataFrame, key: str, ring: str = "ring", rings: str = "rings", pixel: str = "pixel", value: str = "value", size: float = 1000.0) -> DataFrame:
    """(key, count, sum, mean, min, max, n_pixels, covered): statistics of pixels by the area that polygons cover of them.

    pixels have pixel (an id), ring and value; a pixel counts by the share of it that a polygon covers, edge pixels by
    their part and inner ones whole. Pixels without data count for covered alone, which is all the area of the polygon
    that the raster has. A polygon that meets no pixel has no row.
    """
    shares = overlay_area(pixels, polygons, pixel, [key], ring, rings, size)
    whole = F.abs(F.aggregate(F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % F.size(ring))["y"] - F.get(ring, (i + 1) % F.size(ring))["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v)) / 2
    rows = shares.join(pixels.select(pixel, F.col(value).cast("double").alias("_v"), whole.alias("_whole")), pixel)
    share = F.when(F.col("_v").isNotNull(), F.col("area") / F.col("_whole"))
    return rows.groupBy(key).agg(
        F.sum(share).alias("count"), F.sum(share * F.col("_v")).alias("sum"), (F.sum(F.when(F.col("_v").isNotNull(), F.col("area") * F.col("_v"))) / F.sum(F.when(F.col("_v").isNotNull(), F.col("area")))).alias("mean"),
        F.min("_v").alias("min"), F.max("_v").alias("max"), F.count(F.lit(1)).alias("n_pixels"), F.sum("area").alias("covered"),
    )
