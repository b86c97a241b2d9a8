"""One city, one scenario, year by year through all layers: projects to effects, accessibility of the year's network,
delivery, allocation of four bands with its agglomeration loop, clearing. Many scenarios or draws at once, with one band,
are simulation.run's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import access, allocation as al, credibility as cr, market, shocks
from terrane.params import Params
from terrane.plans.simulation import SimulationError
from terrane.sources.ship import kept

c = F.col


@dataclass(frozen=True)
class City:
    """What a run reads. cells: cell, zone, x_m, y_m, price, amenity, disamenity, households, hh_<band>, jobs, population,
    builtup_frac, capacity_sqm, built (residential floorspace), absorbed, inventory, eps and what opportunities need.
    projects: project_id, archetype, cell, x, y, scale, flags, p_completion, announced_year, construction_start,
    open_year. od gives the year's table (cell, zone, mode, minutes), by the state of its network."""

    cells: DataFrame
    projects: DataFrame
    archetypes: DataFrame
    fields: DataFrame
    multipliers: DataFrame
    od: Callable[[int], DataFrame]
    centre: tuple[float, float]


@dataclass
class YearRecord:
    year: int
    turns: int
    spill: dict[str, float]
    delivered: float
    demand: float


@dataclass
class CityRun:
    panel: DataFrame
    years: list[YearRecord] = field(default_factory=list)


def weighted(projects: DataFrame, year: int, p: Params) -> DataFrame:
    """projects with their weight in a year; those without one are left out."""
    years = projects.sparkSession.createDataFrame([(year,)], "year long")
    rows = projects.withColumn("construction_year", F.floor("construction_start"))
    return cr.activation(rows, years, p).filter("weight > 0").drop("year", "construction_year")


def simulate(city: City, years: tuple[int, ...], p: Params, persons: dict[str, float], growth: float, macro: str = "base", office: str = "skip") -> CityRun:
    """The panel (cell, year, price, households, jobs, population, built, delivered, d_ln_p, field, lna) and a record a year.

    Alpha is fitted once, on the first year's accessibility. Capacity that projects take goes in their opening year.
    Demand for floorspace is what was allocated the year before, and what could not be built waits. Households that were
    allocated and could not be must add up to the demand, or the run stops.
    """
    cut = lambda df: kept(df, "city")
    opportunities = lambda x: access.opportunities(x, "zone", p)
    sqm = p.value("behaviour.sqm_per_household")
    first = cut(al.band_accessibility(city.od(years[0]), opportunities(city.cells), "cell", "zone", p))
    alpha = al.fit_alpha(city.cells.join(first, "cell", "left"), p).drop("alpha")
    state = cut(city.cells.join(alpha, "cell").withColumn("backlog", F.lit(0.0)).withColumn("demand", F.lit(0.0)).withColumn("lna", F.lit(None).cast("double")))
    columns, out = state.columns, CityRun(state)
    panel = None
    for year in years:
        effects = shocks.resolve(weighted(city.projects, year, p), city.archetypes, city.fields, city.multipliers, city.cells, year, p, city.centre, office)
        felt = shocks.composed(effects.fields, p).filter("target = 'residential'").select("cell", "field")
        taken = effects.supply.filter(c("start_year") == year).groupBy("cell").agg(F.sum("delta_capacity").alias("_taken"))
        jobs = cut(effects.employment)
        now = state.join(felt, "cell", "left").join(taken, "cell", "left").fillna(0.0, ["field", "_taken"])
        now = now.withColumn("capacity_sqm", F.greatest(F.lit(0.0), c("capacity_sqm") + c("_taken"))).drop("_taken")
        now = now.withColumn("cap", market.absorption_cap(c("absorbed"), F.lit(float(year - years[0])), F.lit(1.0), market.damping(c("inventory"), p), p))
        now = market.deliver(now).withColumn("built", c("built") + c("delivered")).withColumn("headroom", F.greatest(F.lit(0.0), c("capacity_sqm") - c("built")))
        now = cut(now)
        got = al.allocate(now, city.od(year), "zone", opportunities, jobs, year, p, cut, persons, growth)
        mid = sum((c(f"lna_{b}") for b in al.BANDS), F.lit(0.0)) / len(al.BANDS)
        new = sum((c(f"got_{b}") for b in al.BANDS), F.lit(0.0))
        rows = got.cells.withColumn("_lna", mid).withColumn("_new", new).withColumn("d_lna", F.coalesce(c("_lna") - c("lna"), F.lit(0.0)))
        rows = rows.withColumn("d_ln_d", market.demand_shift(c("d_lna"), c("households") - c("_new"), c("_new"), c("field"), p)).withColumn("d_ln_s0", F.lit(0.0))
        rows = market.clear_market(rows.withColumn("quantity", c("built")).withColumn("headroom_sqm", c("headroom")), p, float(p.value(f"price.phi_{macro}")))
        space = sum((c(f"got_{b}") * float(sqm[b]) for b in al.BANDS), F.lit(0.0))
        rows = rows.withColumn("price", c("price") * F.exp("d_ln_p")).withColumn("demand", space).withColumn("backlog", c("backlog_left")).withColumn("lna", c("_lna"))
        rows = cut(rows)
        said = rows.agg(F.sum("delivered").alias("delivered"), F.sum("demand").alias("demand"), F.sum("_new").alias("new"), F.count_if(c("built") < 0).alias("bad")).first()
        wanted = al.household_demand(now, jobs, year, p, growth).select(sum((c(f"demand_{b}") for b in al.BANDS), F.lit(0.0)).alias("n")).first()["n"]
        if said["bad"] or abs(said["new"] + sum(got.spill.values()) - wanted) > 1e-6 * max(1.0, wanted):
            raise SimulationError(f"{year}: households or floorspace do not add up")
        out.years.append(YearRecord(year, got.iterations, got.spill, said["delivered"], said["demand"]))
        part = rows.select("cell", F.lit(year).cast("long").alias("year"), "price", "households", "jobs", "population", "built", "delivered", "d_ln_p", "field", "lna")
        panel = part if panel is None else panel.unionByName(part)
        state = rows.select(*columns)
    out.panel = panel
    return out
