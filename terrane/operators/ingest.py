"""Tabular and vector sources to cells: overlays, counts in polygons, distances to layers, grids, detection classes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators.cover import distance_to_pieces, inside_polygons, line_pieces, overlay_area
from terrane.operators.measures import majority
from terrane.sources.ship import kept

RING = "array<struct<x:double,y:double>>"


def hex_ring(q: int, r: int, size: float) -> list[tuple[float, float]]:
    """Corners of the pointy-top hexagon (q, r) of this side."""
    cx, cy = size * math.sqrt(3) * (q + r / 2), size * 1.5 * r
    return [(cx + size * math.cos(math.radians(60 * i - 30)), cy + size * math.sin(math.radians(60 * i - 30))) for i in range(6)]


def hex_grid(spark: SparkSession, size: float, width: float, height: float, parent: int = 3) -> DataFrame:
    """(cell, parent, q, r, x_m, y_m, area_sqm) of all hexagons whose centre lies in the box; ids are our own."""
    rows = spark.range(int(height // (1.5 * size)) + 1).withColumnRenamed("id", "r")
    span = int(width // (math.sqrt(3) * size)) + 1
    first = F.ceil(-F.col("r") / 2).cast("long")
    out = rows.withColumn("q", F.explode(F.sequence(first, first + span)))
    out = out.withColumn("x_m", size * math.sqrt(3) * (F.col("q") + F.col("r") / 2)).withColumn("y_m", size * 1.5 * F.col("r")).filter(F.col("x_m") <= width)
    name = lambda q, r: F.concat_ws("_", q.cast("string"), r.cast("string"))
    return out.select(name(F.col("q"), F.col("r")).alias("cell"), name(F.floor(F.col("q") / parent), F.floor(F.col("r") / parent)).alias("parent"), "q", "r", "x_m", "y_m", F.lit(1.5 * math.sqrt(3) * size * size).alias("area_sqm"))


def neighbours(cells: DataFrame, k: int = 1) -> DataFrame:
    """(cell, other) of hexagons at most k steps apart, themselves left out: an equi-join on coordinates."""
    steps = [(dq, dr) for dq in range(-k, k + 1) for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1) if (dq, dr) != (0, 0)]
    near = cells.select("cell", F.explode(F.array(*[F.struct((F.col("q") + dq).alias("q"), (F.col("r") + dr).alias("r")) for dq, dr in steps])).alias("n")).select("cell", "n.q", "n.r")
    return near.join(cells.select(F.col("cell").alias("other"), "q", "r"), ["q", "r"]).select("cell", "other")


def hex_rings(cells: DataFrame, size: float) -> DataFrame:
    """cells (q, r, x_m, y_m) with ring, their corners, anticlockwise."""
    corner = lambda i: F.struct((F.col("x_m") + size * math.cos(math.radians(60 * i - 30))).alias("x"), (F.col("y_m") + size * math.sin(math.radians(60 * i - 30))).alias("y"))
    return cells.withColumn("ring", F.array(*[corner(i) for i in range(6)]))


def hex_cover(spark: SparkSession, boundary: DataFrame, size: float, halo: int, parent: int = 3) -> DataFrame:
    """Hexagons that share area with a boundary's rings (x and y from 0 up), and those at most halo steps from them.

    (cell, parent, q, r, x_m, y_m, area_sqm, ring, in_city): the cover is where the area shared is above zero, so a
    boundary's own cells are never lost at its edge; the halo has in_city false.
    """
    most = lambda n: F.max(F.array_max(F.transform("ring", lambda p: p[n]))).alias(n)
    box = boundary.agg(most("x"), most("y")).first()
    grid = hex_rings(hex_grid(spark, size, box["x"] + 2 * size * (halo + 1), box["y"] + 2 * size * (halo + 1), parent), size)
    inside = overlay(grid, boundary, "cell", [], 4 * size).select("cell").distinct()
    named = grid.join(inside.withColumn("_in", F.lit(True)), "cell", "left").withColumn("in_city", F.coalesce("_in", F.lit(False))).drop("_in")
    if not halo:
        return named.filter("in_city")
    near = neighbours(named, halo).join(named.filter("in_city").select(F.col("cell").alias("other")), "other").select("cell").distinct()
    return named.join(near.withColumn("_near", F.lit(True)), "cell", "left").filter("in_city OR _near").drop("_near")


def counts_in(points: DataFrame, polygons: DataFrame, cell: str, kind: str, kinds: list[str], square: float = 1000.0) -> DataFrame:
    """Points of each kind in each polygon; polygons without points have zeros."""
    inside = inside_polygons(points, polygons.select(cell, F.array("ring").alias("rings")), "rings", [cell], square, "x", "y")
    counts = inside.groupBy(cell).pivot(kind, kinds).count()
    return polygons.select(cell).join(counts, cell, "left").fillna(0, kinds)


def overlay(cells: DataFrame, layer: DataFrame, cell: str, keep: list[str], square: float = 1000.0) -> DataFrame:
    """(cell, keep..., area) of what rings of a layer share with convex cells, by columns keep of the layer."""
    rings = layer.select(*keep, F.array("ring").alias("rings"))
    return overlay_area(cells, rings, cell, keep, size=square)


def zoning(pieces: DataFrame, cells: DataFrame, cell: str, least: float) -> DataFrame:
    """Zone of most area, area-weighted FAR and covered share of each cell; null where too little is covered."""
    far = pieces.groupBy(cell).agg((F.sum(F.col("far") * F.col("area")) / F.sum("area")).alias("far"), F.sum("area").alias("covered"))
    best = majority(pieces, cell, "zone", "area").select(cell, F.col("majority").alias("zone"))
    out = cells.select(cell, "area_sqm").join(far, cell, "left").join(best, cell, "left").withColumn("share", F.coalesce(F.col("covered") / F.col("area_sqm"), F.lit(0.0)))
    enough = F.col("share") >= least
    return out.select(cell, F.when(enough, F.col("zone")).alias("zone"), F.when(enough, F.col("far")).alias("far"), "share")


def interpolate(pieces: DataFrame, total: str, source_area: str, cell: str) -> DataFrame:
    """Extensive totals shared by area."""
    return pieces.groupBy(cell).agg(F.sum(F.col(total) * F.col("area") / F.col(source_area)).alias(total))


def distance_to_lines(points: DataFrame, lines: DataFrame, key: str, ceiling: float, start: float = 500.0) -> DataFrame:
    """Distance to the nearest line (an array of points), at most the ceiling."""
    pieces = line_pieces(lines, "line", [], min(start, ceiling))
    return distance_to_pieces(points, pieces, key, ceiling, "x_m", "y_m", lambda df: kept(df, "lines"), start)


def slope_percent(grid: DataFrame, row: str, col: str, z: str, width_m: float, height_m: float) -> DataFrame:
    """grid with slope_pct: central differences along rows and columns, one-sided at the edges."""

    def gradient(by: str, along: str) -> Column:
        w = Window.partitionBy(by).orderBy(along)
        after, before = F.lead(z).over(w), F.lag(z).over(w)
        two = F.when(after.isNotNull() & before.isNotNull(), 2).otherwise(1)
        return (F.coalesce(after, F.col(z)) - F.coalesce(before, F.col(z))) / two

    return grid.withColumn("_dx", gradient(row, col) / width_m).withColumn("_dy", gradient(col, row) / height_m).withColumn("slope_pct", 100 * F.hypot("_dx", "_dy")).drop("_dx", "_dy")


def population_by(year_people: Column, rate: float, years: float) -> Column:
    """People after some years of compound growth."""
    return year_people * F.pow(F.lit(1 + rate), F.lit(float(years)))


def outer_merge(frame: DataFrame, other: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Both frames by key, whichever has it, then on the cells' own keys alone."""
    return cells.select(key).join(frame.join(other, key, "full"), key, "left")


def registry_problems(projects: DataFrame, stages: list[str], forms: list[str], history: DataFrame | None = None, author: str = "model") -> DataFrame:
    """(project_id, problem) of every rule that a register breaks, all together: no id or a repeated one, an unknown
    stage or form, a size that is not positive, a completion before the announcement, a later stage than is seen, and
    no source, where projects have source_urls.

    With a history (project_id, field, changed_by), a stage after the first one needs a row of it that a person signed:
    one whose changed_by does not begin with author.
    """
    c = F.col
    if history is not None:
        signed = history.filter((c("field") == "stage") & ~F.startswith(F.coalesce("changed_by", F.lit("")), F.lit(author))).select(c("project_id").alias("_signed")).distinct()
        projects = projects.join(signed, c("project_id") == c("_signed"), "left")
    again = F.count(F.lit(1)).over(Window.partitionBy("project_id")) > 1
    rules = {
        "no_id": c("project_id").isNull(), "repeated": F.coalesce(again, F.lit(False)) & c("project_id").isNotNull(), "stage": ~F.coalesce(c("stage").isin(*stages), F.lit(False)),
        "commitment": ~c("is_public") & ~F.coalesce(c("commitment_form").isin(*forms), F.lit(False)), "size": ~F.coalesce(c("capex") > 0, F.lit(False)),
        "dates": F.coalesce(c("open_year") < c("announced_year"), F.lit(False)), "not_seen": c("claims_construction") & (c("physical_state") == "none"),
    }
    if "source_urls" in projects.columns:
        rules["no_source"] = F.size(F.coalesce("source_urls", F.array())) == 0
    if history is not None:
        rules["unsigned"] = c("_signed").isNull() & ~F.coalesce(c("stage") == stages[0], F.lit(False))
    found = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))
    return projects.select("project_id", found.alias("_f")).select("project_id", F.explode("_f").alias("problem"))


def physical_state(dndvi: Column, dndbi: Column, dbsi: Column, light: Column, cut: dict[str, float]) -> Column:
    """Most advanced state whose signs are all there; none otherwise."""
    return (
        F.when((dndbi >= cut["built"]) & (light >= cut["light"]), "operating").when(dndbi >= cut["built"], "structure")
        .when((dndvi <= -cut["green"]) & (dbsi >= cut["soil"]), "earthworks").when(dndvi <= -cut["green"], "cleared").otherwise("none")
    )


def mark_imputed(df: DataFrame, column: str, mask: Column, method: str) -> DataFrame:
    """Flags values as imputed; the first method that did it stays."""
    flag, how = f"{column}__imputed", f"{column}__method"
    old = F.coalesce(F.col(flag), F.lit(False)) if flag in df.columns else F.lit(False)
    said = F.col(how) if how in df.columns else F.lit(None).cast("string")
    return df.withColumn(how, F.when(mask & ~old, method).otherwise(said)).withColumn(flag, old | mask)


def merge(cells: DataFrame, frame: DataFrame, key: str) -> DataFrame:
    """Left join that replaces columns; a key that frame repeats raises."""
    if not frame.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} is repeated")
    return cells.drop(*[c for c in frame.columns if c != key and c in cells.columns]).join(frame, key, "left")
