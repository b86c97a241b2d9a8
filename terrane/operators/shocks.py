"""What an announced project does, set-based: projects joined with a table of archetypes give one table of effects of
each kind; projects without weight in a year give none."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalar import clip, wedge
from terrane.operators.allocation import wage_band
from terrane.operators.cover import POINT, distances_within, inside_polygons, line_pieces, near_small_shapes, ring_pieces
from terrane.operators.spatial import nearest_of
from terrane.params import ParamError, Params
from terrane.sources.ship import kept

c = F.col
#: One row an archetype; null employment columns mean that it employs nobody.
ARCHETYPES = (
    "archetype string, sector string, jobs_per_unit double, wage double, capture_m double, dormitory_share double, ownership_share double, peak_per_unit double, local_retention double, "
    "construction_years double, ramp_years double, sterilises boolean, land_take double, dormitory_sqm double, network string, speed_kmh double"
)
#: One row a band of a field: category premium, disamenity or construction_penalty; decay step, linear or exponential.
FIELDS = "archetype string, category string, target string, max_m double, value double, decay string, wedge boolean, applies_when string"
#: One row a flag that multiplies an archetype's premiums.
MULTIPLIERS = "archetype string, flag string, factor double"
TARGETS = ("residential", "commercial", "office")
#: Shapes of at most so many points, and a box of at most so many times the reach, go to the squares of their box whole.
SMALL_POINTS, SMALL_BOX = 64, 4.0


class ShockError(ValueError):
    """An archetype or field is not declared as it should be."""


@dataclass(frozen=True)
class Effects:
    """Tables of one year's effects, by project."""

    employment: DataFrame
    households: DataFrame
    supply: DataFrame
    floorspace: DataFrame
    network: DataFrame
    made: Callable[[], DataFrame]

    @cached_property
    def fields(self) -> DataFrame:
        """Made when it is first asked for: it alone needs shapes and the cells around them."""
        return self.made()


def site_cells(projects: DataFrame, cells: DataFrame, start: float | None = None) -> DataFrame:
    """projects with site, the declared cell if it is one of cells, else the one with the nearest centre, however far.

    Projects without a declared cell and without x and y have no site and go. start: the first radius that is tried.
    """
    # many projects share a cell or a place; each is looked up once
    declared = kept(projects.select("cell").distinct().join(cells.select("cell"), "cell", "left_semi").select(c("cell").alias("_declared")), "declared")
    known = projects.join(declared, c("cell") == c("_declared"), "left")
    centres = cells.select(c("cell").alias("_near"), c("x_m").alias("_cx"), c("y_m").alias("_cy"))
    places = known.filter("_declared IS NULL").select(c("x").cast("double").alias("_lost_x"), c("y").cast("double").alias("_lost_y")).distinct()
    near = nearest_of(kept(places, "places"), ["_lost_x", "_lost_y"], centres, "_near", "_lost_x", "_lost_y", "_cx", "_cy", lambda df: kept(df, "nearest"), start).select("_lost_x", "_lost_y", "_near")
    out = known.join(near, c("_declared").isNull() & (c("x") == c("_lost_x")) & (c("y") == c("_lost_y")), "left").withColumn("site", F.coalesce("_declared", "_near"))
    return out.filter("site IS NOT NULL").drop("_declared", "_near", "_lost_x", "_lost_y")


def _shaped(rows: DataFrame) -> DataFrame:
    """rows with shape, an array of points (x, y), area (whether it is a ring), and the shape's centre _ox, _oy.

    Without shape, or where it is null or empty, the shape is the point x, y. The centre is a line's by length and a
    ring's by area; where these are 0, the mean of the points.
    """
    if "shape" not in rows.columns:
        rows = rows.withColumn("shape", F.lit(None).cast(f"array<{POINT}>"))
    if "area" not in rows.columns:
        rows = rows.withColumn("area", F.lit(False))
    point = F.array(F.struct(c("x").cast("double").alias("x"), c("y").cast("double").alias("y")))
    rows = rows.withColumn("shape", F.when(F.size(F.coalesce("shape", F.array())) > 0, c("shape")).otherwise(point)).withColumn("area", F.coalesce("area", F.lit(False)) & (F.size("shape") > 2))
    n, first = F.size("shape"), F.get("shape", F.lit(0))

    def piece(p: Column, i: Column) -> Column:
        q = F.get("shape", (i + 1) % n)
        ax, ay, bx, by = p["x"] - first["x"], p["y"] - first["y"], q["x"] - first["x"], q["y"] - first["y"]
        w = F.when(c("area"), (ax * by - bx * ay) / 3).when(i + 1 < n, F.hypot(bx - ax, by - ay) / 2).otherwise(0.0)
        return F.struct(w.alias("w"), (w * (ax + bx)).alias("x"), (w * (ay + by)).alias("y"))

    total = lambda name: F.aggregate(F.transform("shape", piece), F.lit(0.0), lambda a, v: a + v[name])
    mean = lambda v: F.aggregate("shape", F.lit(0.0), lambda a, p: a + p[v]) / n
    rows = rows.withColumn("_w", total("w") * F.when(c("area"), 3.0).otherwise(2.0)).withColumn("_cx", total("x")).withColumn("_cy", total("y"))
    centre = lambda v, s: F.when(c("_w") != 0, first[v] + c(s) / F.when(c("_w") != 0, c("_w"))).otherwise(mean(v))
    return rows.withColumn("_ox", centre("x", "_cx")).withColumn("_oy", centre("y", "_cy")).drop("_w", "_cx", "_cy")


def cells_near(rows: DataFrame, cells: DataFrame, reach: float, key: str = "project_id") -> DataFrame:
    """(key, cell, x_m, y_m, dist_m) of the cells within reach of each shape: 0 inside a ring, else to its edge.

    rows have key, shape and area. Shapes are joined by pieces of their edges, so a line of any length is never in one
    row with the squares of its box; what is inside a ring comes from a quadtree. This is for large shapes.
    """
    spots = cells.select("cell", "x_m", "y_m")
    lines = line_pieces(rows.filter("NOT area"), "shape", [key], reach)
    rings = rows.filter("area").select(key, F.array("shape").alias("_rings"))
    pieces = lines.unionByName(ring_pieces(rings, "_rings", [key], reach))
    near = distances_within(spots, pieces, ["cell", "x_m", "y_m"], [key], reach, "x_m", "y_m")
    inside = inside_polygons(spots, rings, "_rings", [key], reach, "x_m", "y_m").select("cell", "x_m", "y_m", key, F.lit(0.0).alias("dist_m"))
    return near.unionByName(inside).groupBy(key, "cell", "x_m", "y_m").agg(F.min("dist_m").alias("dist_m"))


def active_projects(projects: DataFrame, archetypes: DataFrame, year: int) -> DataFrame:
    """Projects (project_id, archetype, site, scale, weight, open_year, construction_start, announced_year, flags) with
    their archetype's columns; an archetype that is not declared raises. archetypes is a table of a few dozen rows."""
    lost = projects.join(F.broadcast(archetypes), "archetype", "left_anti").select("archetype").distinct().limit(5).collect()
    if lost:
        raise ShockError(f"archetypes {sorted(str(r[0]) for r in lost)} are not declared")
    return projects.filter("weight <> 0").join(F.broadcast(archetypes), "archetype").withColumn("year", F.lit(year).cast("long"))


def employment(active: DataFrame) -> DataFrame:
    """Permanent jobs from the opening year, and construction jobs kept locally from the start of building."""
    own = c("scale") * c("weight")
    start = lambda name: F.floor(c(name)).cast("long")
    kinds = F.array(
        F.struct(F.lit(False).alias("is_construction"), c("sector").alias("sector"), (own * c("jobs_per_unit")).alias("jobs"), start("open_year").alias("start_year"), F.lit(None).cast("double").alias("duration_years")),
        F.struct(F.lit(True).alias("is_construction"), F.lit("construction").alias("sector"), (own * c("peak_per_unit") * c("local_retention")).alias("jobs"), start("construction_start").alias("start_year"), c("construction_years").alias("duration_years")),
    )
    rows = active.filter("sector IS NOT NULL").withColumn("_k", F.explode(kinds)).filter("_k.jobs IS NOT NULL")
    return rows.select("project_id", c("site").alias("cell"), "_k.sector", "_k.jobs", "wage", "_k.start_year", "ramp_years", c("capture_m"), F.when(c("_k.is_construction"), 0.0).otherwise(F.coalesce("dormitory_share", F.lit(0.0))).alias("dormitory_share"), "_k.is_construction", "_k.duration_years")


def route_households(active: DataFrame, p: Params) -> DataFrame:
    """Households that permanent jobs bring, in the band of their wage, and workers in dormitories, who are none."""
    jobs = c("scale") * c("weight") * c("jobs_per_unit")
    share = F.create_map(*[F.lit(x) for k, v in p.value("behaviour.inmigrant_share").items() for x in (k, float(v))])[c("sector")]
    dorm = F.coalesce("dormitory_share", F.lit(0.0))
    rows = active.filter("sector IS NOT NULL AND jobs_per_unit IS NOT NULL")
    return rows.select(
        "project_id", c("site").alias("cell"), wage_band(c("wage"), p).alias("band"), (jobs * share / p.value("behaviour.workers_per_household") * (1 - dorm) * F.coalesce("ownership_share", F.lit(1.0))).alias("households"),
        (jobs * dorm).alias("dormitory_workers"), (c("wage") * p.value("behaviour.workers_per_household") * p.value("behaviour.other_income")).alias("income"), "capture_m", F.floor("open_year").cast("long").alias("start_year"), "ramp_years",
    )


def supply(active: DataFrame) -> DataFrame:
    """Capacity that projects on land of their own take away, from the opening year."""
    return active.filter("sterilises").select("project_id", c("site").alias("cell"), (-c("scale") * c("land_take") * c("weight")).alias("delta_capacity"), F.floor("open_year").cast("long").alias("start_year"))


def floorspace(active: DataFrame, p: Params, office: str = "raise") -> DataFrame:
    """Floorspace that jobs ask for: dormitories, and offices where the area of a seat is known; else office='raise'
    raises and 'skip' leaves offices out."""
    jobs = c("scale") * c("weight") * c("jobs_per_unit")
    seat = p.leaf("behaviour.office_sqm_per_seat")["value"]
    if seat is None and office == "raise" and not active.filter("sector = 'it_office' AND jobs_per_unit IS NOT NULL").isEmpty():
        raise ParamError("behaviour.office_sqm_per_seat is null and needs a local value")
    uses = F.array(
        F.struct(F.lit("dormitory").alias("use"), (jobs * F.coalesce("dormitory_share", F.lit(0.0)) * c("dormitory_sqm")).alias("sqm")),
        F.struct(F.lit("office").alias("use"), F.when(c("sector") == "it_office", jobs * F.lit(None if seat is None else float(seat)).cast("double")).alias("sqm")),
    )
    rows = active.filter("sector IS NOT NULL").withColumn("_u", F.explode(uses)).filter("_u.sqm IS NOT NULL")
    return rows.select("project_id", c("site").alias("cell"), "_u.use", "_u.sqm", F.floor("open_year").cast("long").alias("start_year"), "ramp_years")


def network(active: DataFrame) -> DataFrame:
    """Links that projects add to the network when they open."""
    return active.filter("network IS NOT NULL AND network <> 'none'").select("project_id", c("network").alias("kind"), "speed_kmh", F.floor("open_year").cast("long").alias("open_year"))


def premium_multiplier(active: DataFrame, multipliers: DataFrame) -> DataFrame:
    """active with multiplier, the product over the flags that a project carries; 1 without any. multipliers is a table
    of a few dozen rows."""
    by = multipliers.filter("factor IS NOT NULL").groupBy("archetype").agg(F.array_sort(F.collect_list(F.struct("flag", "factor"))).alias("_m"))
    own = F.filter(F.coalesce("_m", F.array().cast("array<struct<flag:string,factor:double>>")), lambda m: F.array_contains("flags", m["flag"]))
    return active.join(F.broadcast(by), "archetype", "left").withColumn("multiplier", F.aggregate(own, F.lit(1.0), lambda a, m: a * m["factor"])).drop("_m")


def decayed(kind: Column, value: Column, distance: Column, reach: Column, rate: float = 3.0) -> Column:
    """A field's value at a distance by the kind of its decay; step where none is named."""
    inside = distance <= reach
    kind = F.coalesce(kind, F.lit("step"))
    return F.when(kind == "linear", value * F.greatest(F.lit(0.0), 1 - distance / reach)).when(kind == "exponential", F.when(inside, value * F.exp(-rate * distance / reach)).otherwise(0.0)).when(kind == "step", F.when(inside, value).otherwise(0.0)).otherwise(
        F.raise_error(F.concat(F.lit("unknown decay "), kind)).cast("double")
    )


def field_effects(active: DataFrame, fields: DataFrame, multipliers: DataFrame, cells: DataFrame, centre: tuple[float, float], strength: float = 0.5) -> DataFrame:
    """(project_id, cell, target, value): of each category's bands for a target the narrowest that holds the cell counts.

    Distances are from a project's shape: shape, an array of points (x, y), a ring where area is true and a line
    otherwise; the point x, y where it is null. The wedge is seen from the shape's centre. Premiums are multiplied by flags; a band that applies_when a flag needs it; the construction
    penalty holds while building.
    """
    reach = fields.agg(F.max("max_m")).first()[0]
    if reach is None:
        return active.select("project_id", c("site").alias("cell"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("double").alias("value")).filter("false")
    held = ["project_id", "archetype", "year", "weight", "flags", "multiplier", "_ox", "_oy", "_from", "_to"]
    # dealt out anew: a small file's projects are one task's otherwise, and meet many cells each
    dealt = active.repartition(int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")), "project_id")
    rows = _shaped(premium_multiplier(dealt, multipliers)).withColumn("_from", F.floor("construction_start")).withColumn("_to", F.floor("open_year")).select(*held, "shape", "area")
    box = lambda v: F.array_max(F.transform("shape", lambda p: p[v])) - F.array_min(F.transform("shape", lambda p: p[v]))
    large = F.coalesce((F.size("shape") > SMALL_POINTS) | (F.greatest(box("x"), box("y")) > SMALL_BOX * float(reach)), F.lit(False))
    near = near_small_shapes(cells, rows.filter(~large), ["cell", "x_m", "y_m"], held, float(reach), "x_m", "y_m", lambda df: kept(df, "cells-near"))
    wide = rows.filter(large)
    if not wide.isEmpty():
        near = near.unionByName(cells_near(wide, cells, float(reach)).join(wide.drop("shape", "area"), "project_id").select(*near.columns))
    # of each category's bands for a target, in order, the first that holds the cell; fields is a table of a few dozen rows
    band = F.struct("max_m", "value", "decay", "wedge", "applies_when")
    by = fields.filter("max_m IS NOT NULL").groupBy("archetype", "category", "target").agg(F.sort_array(F.collect_list(band)).alias("_bands"), F.max("max_m").alias("_most"))
    holds = lambda b: (c("dist_m") <= b["max_m"]) & (b["applies_when"].isNull() | F.array_contains("flags", b["applies_when"]))
    bands = near.join(F.broadcast(by), "archetype").filter(c("dist_m") <= c("_most")).filter((c("category") != "construction_penalty") | ((c("_from") <= c("year")) & (c("year") < c("_to"))))
    bands = bands.withColumn("_b", F.explode(F.slice(F.filter("_bands", holds), 1, 1))).drop("_bands", "_most").select("*", "_b.*").drop("_b")
    size = c("value") * F.when(c("category") == "premium", c("multiplier")).otherwise(1.0)
    value = decayed(c("decay"), size, c("dist_m"), c("max_m"))
    turned = wedge(c("_ox"), c("_oy"), c("x_m"), c("y_m"), F.lit(float(centre[0])), F.lit(float(centre[1])), strength)
    value = value * F.when(F.coalesce("wedge", F.lit(False)), turned).otherwise(1.0) * c("weight")
    each = F.explode(F.when(c("target") == "all", F.array(*[F.lit(t) for t in TARGETS])).otherwise(F.array("target")))
    out = bands.select("project_id", "cell", "category", each.alias("target"), value.alias("value"))
    bad = F.when(~c("target").isin(*TARGETS), F.raise_error(F.concat(F.lit("unknown target "), c("target"))).cast("string")).otherwise(c("target"))
    return out.select("project_id", "cell", "category", bad.alias("target"), "value")


def composed(effects: DataFrame, p: Params) -> DataFrame:
    """(cell, target, raw, field, capped): sums within the price model's bounds."""
    out = effects.groupBy("cell", "target").agg(F.sum("value").alias("raw"))
    return out.withColumn("field", clip(c("raw"), p.value("price.field_low"), p.value("price.field_high"))).withColumn("capped", c("raw") != c("field"))


def resolve(projects: DataFrame, archetypes: DataFrame, fields: DataFrame, multipliers: DataFrame, cells: DataFrame, year: int, p: Params, centre: tuple[float, float], office: str = "raise") -> Effects:
    """All effects of a year's projects, that have weight in it."""
    active = active_projects(site_cells(projects, cells), archetypes, year)
    return Effects(employment(active), route_households(active, p), supply(active), floorspace(active, p, office), network(active), lambda: field_effects(active, fields, multipliers, cells, centre))
