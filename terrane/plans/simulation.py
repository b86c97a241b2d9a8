"""The yearly simulation. Scenario and draw are columns, so base, full, leave-one-out and Monte Carlo runs share one
plan for each year; what one year hands to the next are columns too, written and read again between years."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import allocation as al, credibility as cr, ensemble as en, market, shocks
from terrane.params import Params
from terrane.sources.ship import kept

KEY = ["scenario", "draw", "cell"]


class SimulationError(RuntimeError):
    """A run lost or made floorspace or households, or did not settle."""


@dataclass(frozen=True)
class Scenario:
    """Horizon and changes of a run."""

    name: str
    years: tuple[int, ...]
    disabled: tuple[int, ...] = ()
    forced: tuple[tuple[int, float], ...] = ()
    macro: str = "base"

    def key(self) -> str:
        return hashlib.sha256(json.dumps([self.name, self.years, self.disabled, self.forced, self.macro]).encode()).hexdigest()


@dataclass
class Run:
    panel: DataFrame
    manifest: dict = field(default_factory=dict)


def horizon(first: int, last: int, cap: int = 40) -> tuple[int, ...]:
    if not first <= last < first + cap:
        raise SimulationError(f"horizon {first}-{last} is not within {cap} years")
    return tuple(range(first, last + 1))


#: Most runs (scenarios times draws) of one plan: they are a broadcast table, and every cell has a row for each.
MAX_RUNS = 20_000


def changes(spark: SparkSession, scenarios: list[Scenario]) -> DataFrame:
    """(scenario, project_id, p): projects that a scenario changes; p is null where it disables one."""
    rows = [(s.name, int(x), None) for s in scenarios for x in s.disabled] + [(s.name, int(x), float(v)) for s in scenarios for x, v in s.forced if x not in s.disabled]
    return spark.createDataFrame(rows, "scenario string, project_id long, p double")


def active(projects: DataFrame, scenarios: list[Scenario], p: Params, chances: DataFrame | None = None) -> DataFrame:
    """(scenario, draw, project_id, cell, year, weight, ...): weights of each scenario's projects, zero ones left out.

    What scenarios change is a table to join, so the plan does not grow with it. chances (draw, project_id, p) are a
    Monte Carlo run's own probabilities; without them there is draw 0.
    """
    spark = projects.sparkSession
    names = spark.createDataFrame([(s.name,) for s in scenarios], "scenario string")
    years = spark.createDataFrame([(y,) for y in scenarios[0].years], "year long")
    rows = projects.withColumn("draw", F.lit(0).cast("long")) if chances is None else projects.join(chances.select(F.col("draw").cast("long").alias("draw"), "project_id", F.col("p").alias("_drawn")), "project_id").withColumn("p_completion", F.col("_drawn")).drop("_drawn")
    rows = rows.join(F.broadcast(names))
    told = changes(spark, scenarios).withColumn("_told", F.lit(True))
    rows = rows.join(told, ["scenario", "project_id"], "left").filter("_told IS NULL OR p IS NOT NULL")
    rows = rows.withColumn("p_completion", F.coalesce("p", "p_completion")).drop("p", "_told")
    return cr.activation(rows, years, p).filter("weight > 0")


def effects(weights: DataFrame, per_capex: float = 1e-6, jobs_per_capex: float = 1e-3) -> DataFrame:
    """Field and jobs of each run, cell and year from weights and capex: one partial aggregate. For projects with
    archetypes, shocks.resolve gives the effects in kind."""
    return weights.groupBy("scenario", "draw", "cell", "year").agg(
        F.sum(F.col("weight") * F.col("capex") * per_capex).alias("field"), F.sum(F.col("weight") * F.col("capex") * jobs_per_capex).alias("new_jobs")
    )


def resolved_effects(projects: DataFrame, archetypes: DataFrame, fields: DataFrame, multipliers: DataFrame, cells: DataFrame, scenarios: list[Scenario], p: Params, centre: tuple[float, float], target: str = "residential") -> DataFrame:
    """(scenario, cell, year, field, new_jobs) by archetypes instead of capex, for run's effect: all scenarios of a year
    are resolved in one plan, whose projects are named by scenario; each year is written.

    projects: project_id, archetype, cell, x, y, scale, flags, p_completion, announced_year, construction_start,
    construction_year, open_year. new_jobs is what a year adds to the jobs that are active.
    """
    weights, out = kept(active(projects, scenarios, p), "weights"), None
    for year in scenarios[0].years:
        now = weights.filter(F.col("year") == year).withColumn("project_id", F.concat_ws("|", "scenario", F.col("project_id").cast("string"))).drop("year", "scenario", "draw")
        found = shocks.resolve(now, archetypes, fields, multipliers, cells, year, p, centre, "skip")
        of = F.split_part(F.col("project_id"), F.lit("|"), F.lit(1)).alias("scenario")
        felt = found.fields.filter(F.col("target") == target).select(of, "cell", "value").groupBy("scenario", "cell").agg(F.sum("value").alias("field"))
        jobs = found.employment.select(of, "cell", "jobs", "start_year", "ramp_years", F.lit(0.0).alias("dormitory_share"))
        both = al.active_jobs(jobs, year, p).select("scenario", "cell", F.col("active").alias("n")).unionByName(al.active_jobs(jobs, year - 1, p).select("scenario", "cell", (-F.col("active")).alias("n")))
        added = both.groupBy("scenario", "cell").agg(F.greatest(F.lit(0.0), F.sum("n")).alias("new_jobs"))
        part = felt.join(added, ["scenario", "cell"], "full").select("scenario", "cell", F.lit(year).cast("long").alias("year"), F.coalesce("field", F.lit(0.0)).alias("field"), F.coalesce("new_jobs", F.lit(0.0)).alias("new_jobs"))
        part = kept(part, f"effects-{year}")
        out = part if out is None else out.unionByName(part)
    return out


def network_years(states: DataFrame, tables: dict[str, DataFrame], years: tuple[int, ...]) -> dict[int, DataFrame]:
    """The accessibility table (cell, lna) of each year, by the state of the network in it; a state without one raises."""
    named = {r.year: r.state for r in states.collect()}  # a row a year
    lost = sorted({named.get(y) for y in years} - set(tables), key=str)
    if lost:
        raise SimulationError(f"no accessibility for states {lost}")
    return {y: tables[named[y]] for y in years}


def run(cells: DataFrame, projects: DataFrame, scenarios: list[Scenario], p: Params, draws: DataFrame | None = None, growth: float = 0.02, sqm: float = 65.0, chances: DataFrame | None = None, access: dict[int, DataFrame] | None = None, effect: DataFrame | None = None) -> Run:
    """The panel (scenario, draw, cell, year, ...) of all scenarios and draws.

    cells has the substrate's columns. draws (draw, and any of gamma_mult, phi) gives each draw's price response and
    trend; without it there is draw 0. chances are the draws' probabilities of projects. access gives accessibility by
    year, as networks open; its change moves demand. effect gives the scenarios' effects (resolved_effects); without it
    they are in proportion to capex. Each year: effects, delivery against last year's demand,
    households by logit share, clearing; floorspace and households must add up.
    """
    spark: SparkSession = cells.sparkSession
    years = scenarios[0].years
    if any(s.years != years for s in scenarios):
        raise SimulationError("scenarios differ in their years")
    named = spark.createDataFrame([(s.name, float(p.value(f"price.phi_{s.macro}"))) for s in scenarios], "scenario string, _phi double")
    draws = draws if draws is not None else spark.createDataFrame([(0, 1.0)], "draw long, gamma_mult double")
    runs = draws.select(F.col("draw").cast("long").alias("draw"), *[(F.col(n) if n in draws.columns else F.lit(v)).cast("double").alias(n) for n, v in (("gamma_mult", 1.0), ("phi", None))]).join(F.broadcast(named))
    runs = kept(runs.withColumn("phi", F.coalesce("phi", "_phi")).drop("_phi"), "runs")
    n_runs = runs.count()
    if n_runs > MAX_RUNS:
        raise SimulationError(f"{n_runs} runs; at most {MAX_RUNS} share one plan")
    on = ["scenario", "cell"] if chances is None or effect is not None else ["scenario", "draw", "cell"]
    if effect is None:
        made = kept(effects(active(projects, scenarios, p, chances)), "effects")
        effect = made.drop("draw") if chances is None else made
    state = cells.select("cell", "households", "lna", "amenity", "absorbed", "inventory", "capacity_sqm", "eps", F.col("res_sqm").alias("built"), F.coalesce("price", F.lit(0.0)).alias("price"))
    state = state.join(F.broadcast(runs)).withColumn("backlog", F.lit(0.0)).withColumn("demand", F.lit(0.0))
    state, panel = kept(state, "state"), None
    for year in years:
        now = state.join(effect.filter(F.col("year") == year).drop("year"), on, "left").fillna(0.0, ["field", "new_jobs"])
        if access is not None:
            now = now.join(access[year].select("cell", F.col("lna").alias("_lna")), "cell", "left").withColumn("d_lna", F.coalesce(F.col("_lna") - F.col("lna"), F.lit(0.0))).withColumn("lna", F.coalesce("_lna", "lna")).drop("_lna")
        else:
            now = now.withColumn("d_lna", F.lit(0.0))
        now = now.withColumn("cap", market.absorption_cap(F.col("absorbed"), F.lit(float(year - years[0])), F.lit(1.0), market.damping(F.col("inventory"), p), p))
        now = market.deliver(now)
        total = now.groupBy("scenario", "draw").agg((F.sum("households") * growth + F.sum("new_jobs") / p.value("behaviour.workers_per_household")).alias("wanted"))
        now = market.softmax(now.withColumn("u", F.col("lna") + F.col("amenity") + F.col("field")), "u", "share", ["scenario", "draw"]).join(total, ["scenario", "draw"])
        now = now.withColumn("new_households", F.col("share") * F.col("wanted"))
        now = now.withColumn("d_ln_d", F.col("gamma_mult") * market.demand_shift(F.col("d_lna"), F.col("households"), F.col("new_households"), F.col("field"), p)).withColumn("d_ln_s0", F.lit(0.0))
        now = now.withColumn("quantity", F.col("built")).withColumn("headroom_sqm", F.greatest(F.lit(0.0), F.col("capacity_sqm") - F.col("built")))
        now = market.clear_market(now, p, 0.0).withColumn("d_ln_p", F.col("d_ln_p") + F.col("phi"))
        now = now.withColumn("price", F.col("price") * F.exp("d_ln_p")).withColumn("households", F.col("households") + F.col("new_households"))
        now = kept(now.withColumn("built", F.col("built") + F.col("delivered")).withColumn("backlog", F.col("backlog_left")).withColumn("demand", F.col("new_households") * sqm), f"year-{year}")
        check = now.groupBy("scenario", "draw").agg(F.abs(F.sum("new_households") - F.max("wanted")).alias("off"), F.max("wanted").alias("wanted"), F.count_if((F.col("delivered") < 0) | (F.col("to_backlog") > F.col("delivered") + 1e-9)).alias("bad"))
        if not check.filter("off > 1e-6 * greatest(1, wanted) OR bad > 0").isEmpty():
            raise SimulationError(f"{year}: households or floorspace do not add up")
        rows = now.select(*KEY, F.lit(year).cast("long").alias("year"), "price", "households", "built", "delivered", "d_ln_p", "field", "lna")
        panel = rows if panel is None else panel.unionByName(rows)
        state = now.select(*state.columns)
    return Run(panel, {"params": p.hash(), "scenarios": [s.key() for s in scenarios], "years": list(years), "runs": n_runs})


def ensemble(cells: DataFrame, projects: DataFrame, scenario: Scenario, p: Params, n: int, seed: int, growth: float = 0.02, access: dict[int, DataFrame] | None = None) -> Run:
    """n draws of one scenario: trend, price response and the projects' chances are all drawn, each by the seed and the
    number of its draw; projects needs announcer_id and is_public."""
    draws = en.parameter_draws(projects.sparkSession.range(n).withColumnRenamed("id", "draw"), p, ["price.phi_base", "price.gamma"], seed)
    draws = en.macro_draws(draws, seed)
    other = F.create_map(*[F.lit(x) for k in ("bull", "bear") for x in (k, float(p.value(f"price.phi_{k}")))])
    phi = F.coalesce(F.try_element_at(other, F.col("macro")), F.col("price_phi_base"))
    draws = kept(draws.select("draw", phi.alias("phi"), (F.col("price_gamma") / float(p.value("price.gamma"))).alias("gamma_mult")), "draws")
    chances = kept(en.project_draws(projects, draws, seed), "chances")
    return run(cells, projects, [scenario], p, draws, growth, chances=chances, access=access)


def decompose(cells: DataFrame, projects: DataFrame, groups: dict[str, tuple[int, ...]], years: tuple[int, ...], p: Params) -> DataFrame:
    """Leave-one-out attribution of the last year's log price to groups of projects: F + 2 scenarios, one plan."""
    every = tuple(sorted({x for g in groups.values() for x in g}))
    scenarios = [Scenario("full", years), Scenario("base", years, every), *(Scenario(f"no_{g}", years, tuple(sorted(ids))) for g, ids in groups.items())]
    out = run(cells, projects, scenarios, p).panel.filter(F.col("year") == years[-1]).filter("price > 0")
    return market.attribute(out.select("cell", "scenario", F.ln("price").alias("value")), "cell", list(groups), p)


def run_digest(run: Run, *more: DataFrame) -> str:
    """Digest of a whole run: its manifest, its panel and other frames in the order given."""
    said = [json.dumps(run.manifest, sort_keys=True), digest(run.panel), *map(digest, more)]
    return hashlib.sha256("\n".join(said).encode()).hexdigest()


def digest(panel: DataFrame) -> str:
    """Order-free digest of a panel, to 12 significant digits."""
    from terrane.sources.store import content_hash

    return content_hash(panel)
