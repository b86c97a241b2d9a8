"""Columns of cells from sources: buildings, zoning, coast, utilities, parcels, light, guidance, listings, people, points
of interest and distances; with the gates that refuse what is not good enough."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.cover import inside_polygons
from terrane.operators.ingest import distance_to_lines, overlay
from terrane.operators.measures import majority
from terrane.operators.spatial import nearest, within
from terrane.params import ParamError, Params
from terrane.schema import SECTORS
from terrane.sources.ship import kept

LOG = logging.getLogger(__name__)
c = F.col


class IngestError(ValueError):
    """A source lacks what cells need, or may not be used."""


def populated(cells: DataFrame, least_people: float = 1.0) -> DataFrame:
    """Cells of the city where people live, work or have built."""
    return cells.filter(F.coalesce("in_city", F.lit(False)) & ((F.coalesce("population", F.lit(0.0)) >= least_people) | (F.coalesce("builtup_frac", F.lit(0.0)) > 0)))


def storeys(height: Column, by_zone: Column, storey_m: float = 3.2) -> Column:
    """Whole storeys, at least one: of the measured height, else what the zone has."""
    return F.greatest(F.lit(1.0), F.coalesce(F.rint(height / storey_m), by_zone.cast("double"), F.lit(1.0)))


def floorspace(footprints: DataFrame, cells: DataFrame, zones: DataFrame) -> DataFrame:
    """(cell, builtup_frac, floorspace_res_sqm, floorspace_com_sqm) from pieces of footprints (cell, area, height) and
    zones (zone, storeys, res_share); cells (cell, zone, area_sqm). Cells without footprints have zeros.
    """
    rows = footprints.join(cells.select("cell", "zone", "area_sqm"), "cell").join(zones, "zone", "left")
    floors = c("area") * storeys(c("height"), c("storeys"))
    share = F.coalesce("res_share", F.lit(1.0))
    by = rows.groupBy("cell").agg(F.sum("area").alias("_built"), F.sum(floors * share).alias("_res"), F.sum(floors * (1 - share)).alias("_com"))
    out = cells.join(by, "cell", "left")
    return out.select("cell", F.least(F.lit(1.0), F.coalesce(c("_built") / c("area_sqm"), F.lit(0.0))).alias("builtup_frac"), F.coalesce("_res", F.lit(0.0)).alias("floorspace_res_sqm"), F.coalesce("_com", F.lit(0.0)).alias("floorspace_com_sqm"))


def footprint_history(vintages: dict[int, DataFrame], cells: DataFrame) -> DataFrame:
    """(cell, year, builtup_frac) of pieces of footprints by year: one union, one aggregate."""
    every = None
    for year, pieces in sorted(vintages.items()):
        rows = pieces.select("cell", F.lit(year).cast("long").alias("year"), "area")
        every = rows if every is None else every.unionByName(rows)
    if every is None:
        return cells.select("cell", F.lit(None).cast("long").alias("year"), F.lit(None).cast("double").alias("builtup_frac")).filter("false")
    years = F.explode(F.array(*[F.lit(y).cast("long") for y in sorted(vintages)])).alias("year")
    grid = cells.select("cell", "area_sqm", years)
    by = every.groupBy("cell", "year").agg(F.sum("area").alias("_a"))
    return grid.join(by, ["cell", "year"], "left").select("cell", "year", F.least(F.lit(1.0), F.coalesce(c("_a") / c("area_sqm"), F.lit(0.0))).alias("builtup_frac"))


def check_fractions(fractions: DataFrame, by: str, frac: str, tolerance: float) -> DataFrame:
    """fractions, if they sum to one in every group."""
    off = fractions.groupBy(by).agg(F.sum(frac).alias("_s")).filter(F.abs(c("_s") - 1) > tolerance).agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("lo"), F.max("_s").alias("hi")).first()
    if off["n"]:
        raise IngestError(f"fractions of {off['n']} {by}s do not sum to one: {off['lo']:g} to {off['hi']:g}")
    return fractions


def coastal_class(cells: DataFrame, pieces: DataFrame | None, coastal: bool, none: str = "none") -> DataFrame:
    """(cell, crz_class) of most area; cells outside every zone have none. A coastal city without the layer raises."""
    if pieces is None:
        if coastal:
            raise IngestError("a coastal city needs its coastal zones")
        return cells.select("cell", F.lit(none).alias("crz_class"))
    best = majority(pieces, "cell", "zone", "area").select("cell", c("majority").alias("_m"))
    return cells.select("cell").join(best, "cell", "left").select("cell", F.coalesce("_m", F.lit(none)).alias("crz_class"))


def utilities_served(cells: DataFrame, served: DataFrame, least: float = 0.5) -> DataFrame:
    """(cell, util_water, util_sewer) from shares (cell, water, sewer) of area served; a sewer without water does not count."""
    flag = lambda name: F.when(F.coalesce(c(name), F.lit(0.0)) >= least, 1).otherwise(0)
    rows = cells.select("cell").join(served, "cell", "left").select("cell", flag("water").alias("_w"), flag("sewer").alias("_s"))
    return rows.select("cell", c("_w").cast("long").alias("util_water"), (c("_s") * c("_w")).cast("long").alias("util_sewer"))


def fragmentation(footprints: DataFrame, cells: DataFrame, coverage: float) -> DataFrame:
    """(cell, parcel_count, mean_parcel_sqm) inferred from buildings where parcels are not mapped: a building stands for
    a parcel of its own area over the usual coverage; cells without buildings have a null mean."""
    by = footprints.groupBy("cell").agg(F.count(F.lit(1)).alias("parcel_count"), (F.avg("area") / coverage).alias("mean_parcel_sqm"))
    return cells.select("cell").join(by, "cell", "left").select("cell", F.coalesce("parcel_count", F.lit(0)).cast("long").alias("parcel_count"), "mean_parcel_sqm")


def year_or_latest(history: DataFrame, cells: DataFrame, value: str, year: int) -> DataFrame:
    """(cell, value) of a year, or of the latest year there is before data for it exist; the year used is a column."""
    there = history.agg(F.count_if(c("year") == year).alias("_n"), F.max("year").alias("_last")).select(F.when(c("_n") > 0, F.lit(year).cast("long")).otherwise(c("_last").cast("long")).alias("_year"))
    rows = history.join(F.broadcast(there)).filter(c("year") == c("_year")).select("cell", c(value), c("_year").alias("year_used"))
    return cells.select("cell").join(rows, "cell", "left")


def first_match(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each key: the first in an order that must be stated, as partitions have none."""
    if not order:
        raise ValueError("an order is needed")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def values_by_polygon(cells: DataFrame, polygons: DataFrame, value: str, name: str, square: float = 1000.0) -> DataFrame:
    """(cell, value) of the polygon that holds a cell's centre; of several the first by name. Cells outside have null."""
    inside = inside_polygons(cells.select("cell", "x_m", "y_m"), polygons.select(name, value, F.array("ring").alias("rings")), "rings", [name, value], square, "x_m", "y_m")
    one = first_match(inside.select("cell", name, value), ["cell"], [name, value])
    return cells.select("cell").join(one.select("cell", value), "cell", "left")


def listings(points: DataFrame, cells: DataFrame, ask: str, rent: str, least: int = 1) -> DataFrame:
    """(cell, ask, rent, n): medians of the listings of each cell, from points (listing, cell, ask, rent); a listing
    that falls in several cells counts in the first. Cells with fewer than least listings have nulls."""
    one = first_match(points, ["listing"], ["cell"])
    by = one.groupBy("cell").agg(F.median(ask).alias("_a"), F.median(rent).alias("_r"), F.count(F.lit(1)).alias("_n"))
    enough = c("_n") >= least
    return cells.select("cell").join(by, "cell", "left").select("cell", F.when(enough, c("_a")).alias(ask), F.when(enough, c("_r")).alias(rent), F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def check_listing_source(mode: str, licence: str | None, modes: dict[str, tuple[str, ...]]) -> None:
    """Refuses a source of listings whose mode is not known, or whose licence the mode does not allow."""
    if mode not in modes:
        raise IngestError(f"listing mode {mode!r} is not one of {sorted(modes)}")
    if licence not in modes[mode]:
        raise IngestError(f"mode {mode!r} needs a licence in {modes[mode]}, not {licence!r}")


def jobs_proxy(counts: dict[str, Column], per: dict[str, tuple[str, float]]) -> Column:
    """Jobs by sector from counts of points of interest: per names each kind's sector and jobs; absent counts are 0."""
    bad = sorted({s for s, _ in per.values()} - set(SECTORS))
    if bad:
        raise IngestError(f"unknown sectors {bad}")
    of = lambda sector: sum((F.coalesce(counts[k], F.lit(0.0)) * jobs for k, (s, jobs) in per.items() if s == sector and k in counts), F.lit(0.0))
    return F.array(*[of(s).cast("double") for s in SECTORS])


def households(population: Column, sizes: dict[str, float | None]) -> Column:
    """Households from people by the mean size; unknown sizes raise, as no default is right."""
    if not sizes or any(v is None for v in sizes.values()):
        raise ParamError("household sizes are null and need local values")
    return population / (sum(sizes.values()) / len(sizes))


def raster_population(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, population) summed over pixels (cell, value, weight), weight the share of the pixel in the cell."""
    by = pixels.groupBy("cell").agg(F.sum(c("value") * F.coalesce("weight", F.lit(1.0))).alias("population"))
    return cells.select("cell").join(by, "cell", "left").select("cell", F.coalesce("population", F.lit(0.0)).alias("population"))


def distances(cells: DataFrame, centre: tuple[float, float], roads: DataFrame, coast: DataFrame | None, ceiling: float) -> DataFrame:
    """(cell, dist_cbd_m, dist_arterial_m, dist_coast_m) to the centre, the nearest line of roads and of the coast; up to
    the ceiling for lines. Without a coast its distance is null."""
    out = cells.select("cell", "x_m", "y_m", F.hypot(c("x_m") - float(centre[0]), c("y_m") - float(centre[1])).alias("dist_cbd_m"))
    points = cells.select("cell", "x_m", "y_m")
    out = out.join(distance_to_lines(points, roads, "cell", ceiling).withColumnRenamed("dist_m", "dist_arterial_m"), "cell")
    if coast is None:
        return out.select("cell", "dist_cbd_m", "dist_arterial_m", F.lit(None).cast("double").alias("dist_coast_m"))
    return out.join(distance_to_lines(points, coast, "cell", ceiling).withColumnRenamed("dist_m", "dist_coast_m"), "cell").select("cell", "dist_cbd_m", "dist_arterial_m", "dist_coast_m")


def powered(cells: DataFrame, substations: DataFrame, lines: DataFrame, station_reach: float = 2000.0, line_reach: float = 500.0) -> DataFrame:
    """(cell, util_power): a substation (x, y) or a distribution line within reach."""
    near = within(cells.select("cell", "x_m", "y_m"), substations.select("x", "y"), station_reach, "x_m", "y_m", "x", "y").select("cell").distinct().withColumn("_s", F.lit(True))
    along = distance_to_lines(cells.select("cell", "x_m", "y_m"), lines, "cell", line_reach * 2)
    rows = cells.select("cell").join(near, "cell", "left").join(along, "cell", "left")
    return rows.select("cell", F.when(F.coalesce("_s", F.lit(False)) | (c("dist_m") <= line_reach), 1).otherwise(0).cast("long").alias("util_power"))


def map_columns(cells: DataFrame, centre: tuple[float, float], roads: DataFrame, coast: DataFrame | None, substations: DataFrame, lines: DataFrame, counts: DataFrame, kinds: list[str], per: dict[str, tuple[str, float]], ceiling: float = 50_000.0) -> DataFrame:
    """All columns that a map gives: distances, power, counts of points of interest and the jobs they stand for."""
    out = distances(cells, centre, roads, coast, ceiling).join(powered(cells, substations, lines), "cell").join(counts, "cell", "left")
    out = out.fillna(0, kinds)
    return out.withColumn("jobs_by_sector", jobs_proxy({k: c(k).cast("double") for k in kinds}, per))


def project_cells(projects: DataFrame, cells: DataFrame, square: float = 1000.0) -> DataFrame:
    """projects (project_id, x, y) with cell, that whose ring holds them (the first by id on a border); projects outside
    every cell go, and their number is logged."""
    # many projects share a place, and cells of one ring differ by id alone: each place and each ring is looked up once
    places = projects.select("x", "y").distinct()
    rings = cells.groupBy("ring").agg(F.min("cell").alias("cell")).select("cell", F.array("ring").alias("rings"))
    inside = inside_polygons(kept(places, "places"), kept(rings, "rings"), "rings", ["cell"], square, "x", "y")
    found = kept(inside.groupBy("x", "y").agg(F.min("cell").alias("cell")), "found")
    one = first_match(projects.select("project_id", "x", "y").join(found, ["x", "y"]).select("project_id", "cell"), ["project_id"], ["cell"])
    out = projects.join(one, "project_id")
    lost = projects.select("project_id").distinct().join(one, "project_id", "left_anti").count()
    if lost:
        LOG.warning("%d projects lie outside every cell", lost)
    return out


def buffered(points: DataFrame, targets: DataFrame, radius: float, key: str, other: str) -> DataFrame:
    """(key, other) of points (x, y) whose buffer of a radius holds targets (tx, ty): a buffer by its predicate."""
    return within(points, targets, radius, "x", "y", "tx", "ty").select(key, other)


def footprint_pieces(footprints: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, building, height, area): what each building shares with each cell."""
    return overlay(cells, footprints, "cell", ["building", "height"])


def uplift(broker: DataFrame, registered: DataFrame, cells: DataFrame, p: Params) -> DataFrame:
    """(cell, uplift): broker over registered price, fitted on log distance to the centre with a level for each zone.

    Zones with too few observations share one level. Observed cells keep their own ratio. With too few observations in
    all, every cell has their median. The normal equations are one partial aggregate; levels are taken out by
    subtracting zone means, so the number of zones does not matter.
    """
    obs = broker.join(registered, "cell").filter("broker > 0 AND registered > 0").join(cells.select("cell", "zone", "dist_cbd_m"), "cell")
    obs = obs.withColumn("_y", c("broker") / c("registered")).withColumn("_x", F.ln(1 + c("dist_cbd_m")))
    n, median = obs.agg(F.count(F.lit(1)), F.median("_y")).first()
    if n == 0:
        raise IngestError("no cell has both prices")
    if n < int(p.value("ingest.uplift_min_obs")):
        return cells.select("cell", F.lit(float(median)).alias("uplift"))
    sizes = obs.groupBy("zone").agg(F.count(F.lit(1)).alias("_n"))
    level = F.when(c("_n") >= int(p.value("ingest.uplift_min_zone_obs")), c("zone").cast("string")).otherwise("")
    named = obs.join(sizes, "zone").withColumn("_level", F.coalesce(level, F.lit("")))
    means = named.groupBy("_level").agg(F.avg("_y").alias("_my"), F.avg("_x").alias("_mx"))
    slope = named.join(means, "_level").agg(F.try_divide(F.sum((c("_x") - c("_mx")) * (c("_y") - c("_my"))), F.sum((c("_x") - c("_mx")) * (c("_x") - c("_mx")))).alias("_b"))
    whole = obs.agg(F.avg("_y").alias("_ay"), F.avg("_x").alias("_ax"))
    rows = cells.select("cell", "zone", F.ln(1 + c("dist_cbd_m")).alias("_x")).join(sizes, "zone", "left").withColumn("_level", F.coalesce(level, F.lit("")))
    rows = rows.join(means, "_level", "left").join(F.broadcast(slope)).join(F.broadcast(whole)).join(obs.select("cell", "_y"), "cell", "left")
    fitted = F.coalesce("_my", "_ay") + F.coalesce("_b", F.lit(0.0)) * (c("_x") - F.coalesce("_mx", "_ax"))
    return rows.select("cell", F.coalesce("_y", fitted).alias("uplift"))


def nearest_cell(points: DataFrame, cells: DataFrame, reach: float, key: str) -> DataFrame:
    """(key, cell, dist_m) of the nearest centre within reach; ties by id."""
    return nearest(within(points, cells.select("cell", "x_m", "y_m"), reach, "x", "y", "x_m", "y_m"), key, "cell")
