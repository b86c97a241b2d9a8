"""Change detection from monthly composites: cloud masks, valid months, a baseline before the announcement, states by
differences from it, the ratchet, and what is written back. All projects share one plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalar import bare_soil, normalized_difference
from terrane.operators.measures import ratchet
from terrane.params import Params

c = F.col
#: Digits after the point that differences keep where they meet a threshold: what lies beyond is left of the means' sums.
EXACT = 12
#: Fixed vocabulary: states in order.
STATES = ("none", "cleared", "earthworks", "structure", "operational")


class BaselineError(ValueError):
    """Too few valid months before an announcement."""


def clear(scl: Column, p: Params) -> Column:
    """Whether a pixel's scene class is neither cloud nor shadow; null classes are not clear."""
    return F.coalesce(~scl.isin(*p.value("satellite.cloud_codes")), F.lit(False))


def brightness(b02: Column, b03: Column, b04: Column) -> Column:
    """Mean of the visible bands."""
    return (b02 + b03 + b04) / 3


def monthly(pixels: DataFrame, p: Params, scene_pixels: Column | None = None) -> DataFrame:
    """(project_id, month, ndvi, ndbi, bsi, brightness, cloud_frac, valid) from pixels (project_id, time, px, scl, b02,
    b03, b04, b08, b11).

    Each pixel takes its median over the month's clear scenes, the project the mean of its pixels. A month is valid if
    few enough of its observations are unclear and enough of its pixels were clear once.
    """
    ok = clear(c("scl"), p)
    bands = ("b02", "b03", "b04", "b08", "b11")
    per = pixels.groupBy("project_id", F.trunc("time", "month").alias("month"), "px").agg(
        *[F.median(F.when(ok, c(b))).alias(b) for b in bands], F.count(F.lit(1)).alias("_n"), F.count_if(~ok).alias("_bad"),
    )
    out = per.groupBy("project_id", "month").agg(
        F.avg(normalized_difference(c("b08"), c("b04"))).alias("ndvi"), F.avg(normalized_difference(c("b11"), c("b08"))).alias("ndbi"), F.avg(bare_soil(c("b02"), c("b04"), c("b08"), c("b11"))).alias("bsi"),
        F.avg(brightness(c("b02"), c("b03"), c("b04"))).alias("brightness"), (F.sum("_bad") / F.sum("_n")).alias("cloud_frac"), F.avg((c("_bad") < c("_n")).cast("double")).alias("_clear"),
    )
    valid = (c("cloud_frac") <= p.value("satellite.max_unclear")) & (c("_clear") >= p.value("satellite.min_clear")) & c("ndvi").isNotNull()
    return out.withColumn("valid", valid).drop("_clear")


def baselines(months: DataFrame, projects: DataFrame, p: Params, thin: str = "raise") -> DataFrame:
    """(project_id, ndvi0, ndbi0, bsi0, light0): means over the valid months before the announcement.

    A project with fewer than the least number of them raises, is left out with thin='skip', or has nulls with
    thin='null'. months may have light.
    """
    light = c("light") if "light" in months.columns else F.lit(None).cast("double")
    before = c("month") < c("announced_date")
    good = before & c("valid")
    rows = projects.select("project_id", "announced_date").join(months.withColumn("_light", light), "project_id", "left")
    mean = lambda name: F.avg(F.when(good, c(name)))
    out = rows.groupBy("project_id").agg(F.count_if(good).alias("_n"), mean("ndvi").alias("ndvi0"), mean("ndbi").alias("ndbi0"), mean("bsi").alias("bsi0"), F.avg(F.when(before, c("_light"))).alias("light0"))
    least = int(p.value("satellite.min_baseline_months"))
    if thin == "raise":
        few = out.filter(c("_n") < least).select("project_id").orderBy("project_id").limit(5).collect()
        if few:
            raise BaselineError(f"fewer than {least} valid months before the announcement: {[r[0] for r in few]}")
    if thin == "null":
        return out.select("project_id", *[F.when(c("_n") >= least, c(n)).alias(n) for n in ("ndvi0", "ndbi0", "bsi0", "light0")])
    return out.filter(c("_n") >= least).drop("_n")


def classified(dndvi: Column, dndbi: Column, dbsi: Column, light_rose: Column, p: Params) -> Column:
    """The most advanced state whose signs are all there; none for what is neither.

    Differences are rounded first: one that is a threshold, but for the order in which means were summed, does not pass it.
    """
    dndvi, dndbi, dbsi = (F.round(d, EXACT) for d in (dndvi, dndbi, dbsi))
    cleared, works = p.value("satellite.cleared"), p.value("satellite.earthworks")
    built = dndbi > p.value("satellite.structure_dndbi_min")
    return (
        F.when(built & light_rose, "operational").when(built, "structure")
        .when((dndvi < works["dndvi_max"]) & (dbsi > works["dbsi_min"]) & (dndbi < works["dndbi_max"]), "earthworks")
        .when((dndvi < cleared["dndvi_max"]) & (dndbi < cleared["dndbi_max"]), "cleared").otherwise("none")
    )


def detect(months: DataFrame, projects: DataFrame, p: Params, thin: str = "raise") -> DataFrame:
    """months with dndvi, dndbi, dbsi, light_rose, state and state_cum, the highest state so far.

    Months that are not valid have no state and do not move it, nor do those of a project without a baseline (thin =
    'null'). Light rose where it is above its own mean before the announcement by the least share; without light it
    never does.
    """
    rows = months.join(baselines(months, projects, p, thin), "project_id")
    light = c("light") if "light" in months.columns else F.lit(None).cast("double")
    rise = F.when(c("light0") != 0, (light - c("light0")) / F.abs(F.when(c("light0") != 0, c("light0"))))
    rows = rows.withColumn("light_rose", F.coalesce(F.round(rise, EXACT) > p.value("satellite.light_rise_min"), F.lit(False)))
    for name in ("ndvi", "ndbi", "bsi"):
        rows = rows.withColumn(f"d{name}", c(name) - c(f"{name}0"))
    state = F.when(c("valid") & c("ndvi0").isNotNull(), classified(c("dndvi"), c("dndbi"), c("dbsi"), c("light_rose"), p))
    rows = rows.withColumn("state", state).withColumn("_rank", F.when(c("state").isNotNull(), F.array_position(F.array(*[F.lit(s) for s in STATES]), c("state")).cast("int")))
    rows = ratchet(rows, "project_id", ["month"], "_rank", "_top")
    cum = F.when(c("_top").isNotNull(), F.element_at(F.array(*[F.lit(s) for s in STATES]), F.coalesce("_top", F.lit(1))))
    return rows.withColumn("state_cum", cum).drop("_rank", "_top", "ndvi0", "ndbi0", "bsi0", "light0")


def latest_states(detected: DataFrame) -> DataFrame:
    """(project_id, physical_state, physical_asof) of the last valid month; none as of the first month without any."""
    known = c("state_cum").isNotNull()
    out = detected.groupBy("project_id").agg(F.max_by("state_cum", F.when(known, c("month"))).alias("_s"), F.max(F.when(known, c("month"))).alias("_m"), F.min("month").alias("_first"))
    return out.select("project_id", F.coalesce("_s", F.lit("none")).alias("physical_state"), F.coalesce("_m", "_first").alias("physical_asof"))


def persist(store, detected: DataFrame, projects: str = "projects", history: str = "project_physical_history") -> None:
    """Writes the months, by project and month, and the states into the projects' own rows."""
    store.write(history, detected.select(*[c(x.name) for x in store.tables[history].columns]), "upsert")
    old = store.read(projects)
    states = latest_states(detected)
    fresh = old.drop("physical_state", "physical_asof").join(states, "project_id").select(*old.columns)
    store.write(projects, fresh, "upsert")


def aoi_bounds(west: float, south: float, east: float, north: float, buffer_m: float) -> tuple[float, float, float, float]:
    """Bounds in degrees, widened by a buffer in metres on the ellipsoid at the latitude farthest from the equator."""
    from terrane.functions.scalar import WGS84_A, WGS84_F

    if not (-180 <= west <= east <= 180 and -90 <= south <= north <= 90):
        raise ValueError("bounds are not degrees in order")
    e2 = WGS84_F * (2 - WGS84_F)
    phi = math.radians(max(abs(south), abs(north)))
    w = math.sqrt(1 - e2 * math.sin(phi) ** 2)
    dlat = math.degrees(buffer_m / (WGS84_A * (1 - e2) / (1 - e2 * math.sin(min(abs(math.radians(south)), abs(math.radians(north)))) ** 2) ** 1.5))
    dlon = math.degrees(buffer_m / (WGS84_A / w * math.cos(phi)))
    return max(-180.0, west - dlon), max(-90.0, south - dlat), min(180.0, east + dlon), min(90.0, north + dlat)
