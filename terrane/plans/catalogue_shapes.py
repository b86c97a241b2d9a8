"""Queries of shapes, vector formats and rasters, with their DuckDB SQL on shapes that are parallel to the axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geometry
from terrane.operators import cover, ingest, raster
from terrane.plans.catalogue import TIE, add

c = F.col
HALF = 200.0


def _corner(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(_corner(x0, y0), _corner(x1, y0), _corner(x1, y1), _corner(x0, y1))


def districts(d: DataFrame) -> DataFrame:
    """Rectangles, rectangles with a hole, and rectangles without their upper right quarter.

    Dealt out by id: suppliers are few bytes, and what is made of each would be the work of one task otherwise.
    """
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "zone_id")
    x1, y1 = c("x0") + c("wide"), c("y0") + c("high")
    whole, hole = box(c("x0"), c("y0"), x1, y1), box(c("rx0"), c("ry0"), c("rx1"), c("ry1"))
    angle = F.array(_corner(c("x0"), c("y0")), _corner(x1, c("y0")), _corner(x1, c("ry0")), _corner(c("rx0"), c("ry0")), _corner(c("rx0"), y1), _corner(c("x0"), y1))
    return d.withColumn("rings", F.when(c("form") == 1, F.array(whole, hole)).when(c("form") == 2, F.array(angle)).otherwise(F.array(whole)))


def squares(x: DataFrame) -> DataFrame:
    """A square of 400 m around each cell's centre."""
    return x.withColumn("ring", box(c("x_m") - HALF, c("y_m") - HALF, c("x_m") + HALF, c("y_m") + HALF))


def shared(d: DataFrame, x: DataFrame) -> DataFrame:
    """(cell, zone_id, area), in whole tenths of a square metre."""
    return cover.overlay_area(squares(x), districts(d), "cell", ["zone_id"], size=500.0).withColumn("area", F.round("area", 1)).filter("area > 0")


_over = lambda x0, y0, x1, y1: f"greatest(0, least(x_m + 200, {x1}) - greatest(x_m - 200, {x0})) * greatest(0, least(y_m + 200, {y1}) - greatest(y_m - 200, {y0}))"
PIECES = f"""pc AS (SELECT cell, zone_id, people, a_districts.zone, far, wide * high - (rx1 - rx0) * (ry1 - ry0) AS zone_area, {_over('x0', 'y0', 'x0 + wide', 'y0 + high')} - {_over('rx0', 'ry0', 'rx1', 'ry1')} AS area
  FROM a_cells JOIN a_districts ON x_m + 200 > x0 AND x_m - 200 < x0 + wide AND y_m + 200 > y0 AND y_m - 200 < y0 + high), pieces AS (SELECT * FROM pc WHERE area > 0)"""
add("overlay_area", "a_districts a_cells", f"WITH {PIECES} SELECT cell, zone_id, round(area, 1) AS area FROM pieces", lambda d, x: shared(d, x))
add("interpolated_people", "a_districts a_cells", f"WITH {PIECES} SELECT cell, round(sum(people * area / zone_area), 6) AS people FROM pieces GROUP BY cell", lambda d, x: _interpolated(d, x))
add("zoning_by_overlay", "a_districts a_cells", f"""WITH {PIECES}, t AS (SELECT cell, sum(far * area) / sum(area) AS far, sum(area) / 160000e0 AS share FROM pieces GROUP BY cell),
  m AS (SELECT cell, zone FROM (SELECT cell, zone, row_number() OVER (PARTITION BY cell ORDER BY sum(area) DESC, zone) AS r FROM pieces GROUP BY cell, zone) WHERE r = 1)
  SELECT a.cell, CASE WHEN share >= 0.5 THEN m.zone END AS zone, round(CASE WHEN share >= 0.5 THEN t.far END + 1e-9, 6) AS far, round(coalesce(share, 0) + 1e-9, 6) AS share FROM a_cells a LEFT JOIN t USING (cell) LEFT JOIN m USING (cell)""",
    lambda d, x: ingest.zoning(shared(d, x).join(d.select("zone_id", "zone", "far"), "zone_id"), x.select("cell", F.lit(4 * HALF * HALF).alias("area_sqm")), "cell", 0.5).withColumns({"far": c("far") + TIE, "share": c("share") + TIE}))
add("zonal_exact", "a_districts a_cells", f"""WITH {PIECES}, v AS (SELECT pieces.*, CASE WHEN cell % 11 <> 0 THEN cell % 97 END AS v FROM pieces)
  SELECT zone_id, round(sum(area) FILTER (v IS NOT NULL) / 160000 + 1e-7, 4) AS n, round(sum(area * v) / sum(area) FILTER (v IS NOT NULL) + 1e-7, 4) AS mean, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high, count(*) AS n_pixels, round(sum(area), 1) AS covered FROM v GROUP BY zone_id""",
    lambda d, x: raster.zonal_exact(squares(x).withColumn("value", F.when(c("cell") % 11 != 0, c("cell") % 97)), districts(d), "zone_id", pixel="cell", size=500.0)
    .select("zone_id", F.round(c("count") + 1e-7, 4).alias("n"), F.round(c("mean") + 1e-7, 4).alias("mean"), c("min").alias("low"), c("max").alias("high"), "n_pixels", F.round("covered", 1).alias("covered")))


def _interpolated(d: DataFrame, x: DataFrame) -> DataFrame:
    area = F.aggregate(F.transform("rings", lambda r, i: F.when(i == 0, F.abs(cover.signed_area(r))).otherwise(-F.abs(cover.signed_area(r)))), F.lit(0.0), lambda a, v: a + v)
    return ingest.interpolate(shared(d, x).join(districts(d).select("zone_id", "people", area.alias("zone_area")), "zone_id"), "people", "zone_area", "cell")


# --- vector formats --------------------------------------------------------------------------------------------
add("geometry_round_trip", "a_districts", """WITH f AS (SELECT unnest(['geojson', 'wkb', 'wkt']) AS format)
  SELECT format, zone_id, CASE zone_id % 4 WHEN 0 THEN 'point' WHEN 1 THEN 'linestring' ELSE 'polygon' END AS kind, CASE WHEN zone_id % 4 = 3 THEN 2 ELSE 1 END::INT AS n_parts,
    CASE zone_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE (CASE form WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 4 END) + CASE WHEN zone_id % 4 = 3 THEN 4 ELSE 0 END END::INT AS n_points,
    round(CASE WHEN zone_id % 4 < 2 THEN 0 ELSE wide * high / 9 - (rx1 - rx0) * (ry1 - ry0) / 9 + CASE WHEN zone_id % 4 = 3 THEN wide * high / 9 ELSE 0 END END, 4) AS area,
    round(x0 / 3, 6) AS x, round(y0 / 3, 6) AS y
  FROM a_districts, f""", lambda d: _round_trip(d))


def _round_trip(d: DataFrame) -> DataFrame:
    """Districts at a third of their size as points, lines, polygons and pairs of polygons, written in each format and
    read back; areas and places are those of what was read."""
    third = lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: _corner(p["x"] / 3, p["y"] / 3)))
    rows = districts(d).withColumn("rings", third(c("rings")))
    k = c("zone_id") % 4
    first = F.get("rings", F.lit(0))
    again = F.array(F.transform(F.get(third(F.array(box(c("x0"), c("y0"), c("x0") + c("wide"), c("y0") + c("high")))), F.lit(0)), lambda p: _corner(p["x"] + 50_000, p["y"])))
    parts = F.when(k == 0, F.array(F.array(F.slice(first, 1, 1)))).when(k == 1, F.array(F.array(F.slice(first, 1, 3)))).when(k == 2, F.array(c("rings"))).otherwise(F.array(c("rings"), again))
    rows = rows.select("zone_id", F.when(k == 0, "point").when(k == 1, "linestring").otherwise("polygon").alias("kind"), parts.alias("parts"))
    args = (c("kind"), c("parts"))
    read = {"wkb": geometry.from_wkb(geometry.to_wkb(*args)), "wkt": geometry.from_wkt(geometry.to_wkt(*args)), "geojson": geometry.from_geojson(geometry.to_geojson(*args))}
    out = rows.select("zone_id", F.explode(F.array(*[F.struct(F.lit(n).alias("format"), g.alias("g")) for n, g in read.items()])).alias("_f")).select("zone_id", "_f.format", "_f.g.*")
    ring_area = lambda r, i: F.when(i == 0, F.abs(cover.signed_area(r))).otherwise(-F.abs(cover.signed_area(r)))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    area = F.when(c("kind") == "polygon", total(F.transform("parts", lambda p: total(F.transform(p, ring_area))))).otherwise(0.0)
    points = F.flatten(F.flatten("parts"))
    return out.select("format", "zone_id", "kind", F.size("parts").alias("n_parts"), F.size(points).alias("n_points"), F.round(area, 4).alias("area"), F.get(points, F.lit(0))["x"].alias("x"), F.get(points, F.lit(0))["y"].alias("y"))


# --- rasters ---------------------------------------------------------------------------------------------------
SOURCE = raster.Grid(100.0, 50.0, 10.0, 8.0)
TARGET = raster.Grid(103.0, 47.0, 7.0, 5.0, 2.0, 1.0)
PIXELS = "px AS (SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS r, p_partkey % 50 AS c, CASE WHEN p_partkey % 17 <> 0 THEN p_size END AS v FROM part)"


def _resampled(x: DataFrame, method: str) -> DataFrame:
    row, col = F.floor(c("p_partkey") / 50), c("p_partkey") % 50
    pixels = x.select(row.alias("row"), col.alias("col"), F.when(c("p_partkey") % 17 != 0, c("p_size")).alias("value"))
    # the target's y and x are half and twice the source's
    return raster.resampled(pixels, SOURCE, x.select(row.alias("row"), col.alias("col")), TARGET, lambda a, b: (a * 2 - 100, b / 2 + 25), method)


CENTRES = "t AS (SELECT r, c, ((103 + 7 * (c + 0.5e0) + 2 * (r + 0.5e0)) * 2 - 100 - 100) / 10 AS fc, ((47 + 5 * (r + 0.5e0) + (c + 0.5e0)) / 2 + 25 - 50) / 8 AS fr FROM px)"
add("raster_nearest", "part", f"WITH {PIXELS}, {CENTRES} SELECT t.r AS row, t.c AS col, s.v::DOUBLE AS value FROM t LEFT JOIN px s ON s.r = floor(fr) AND s.c = floor(fc)", lambda x: _resampled(x, "nearest"))
add("raster_resampled", "part", f"""WITH {PIXELS}, {CENTRES}, u AS (SELECT *, floor(fr - 0.5e0) AS r0, floor(fc - 0.5e0) AS c0 FROM t),
  w AS (SELECT u.r, u.c, fr, fc, s.v, s.r AS sr, s.c AS sc, (1 - abs(fr - 0.5e0 - s.r)) * (1 - abs(fc - 0.5e0 - s.c)) AS w FROM u LEFT JOIN px s ON s.r BETWEEN r0 AND r0 + 1 AND s.c BETWEEN c0 AND c0 + 1),
  o AS (SELECT r, c, sum(w * v) / nullif(sum(w) FILTER (v IS NOT NULL), 0) AS value, count(*) FILTER (v IS NOT NULL AND sr = floor(fr) AND sc = floor(fc)) AS own FROM w GROUP BY r, c)
  SELECT r AS row, c AS col, round(CASE WHEN own > 0 THEN value END, 6) AS value FROM o""", lambda x: _resampled(x, "bilinear"))
