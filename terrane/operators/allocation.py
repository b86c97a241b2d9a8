"""Households of four income bands: accessibility and utility by band, demand, the constrained fill, and the yearly
allocation with its agglomeration loop. Cells carry one column a band, so every step is one pass for all bands."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalar import digitize
from terrane.operators.access import minutes
from terrane.operators.measures import quantiles
from terrane.params import Params

BANDS = ("low", "mid", "upper_mid", "high")
PURPOSES = ("work", "retail", "education", "health")
LOG = logging.getLogger(__name__)
c = F.col


class ConvergenceError(RuntimeError):
    """The agglomeration loop grows, or does not settle."""


def beta(p: Params, purpose: str, mode: str) -> float:
    """Decay of a purpose; work's is by mode, with two-wheelers as cars and metro as transit."""
    if purpose != "work":
        return float(p.value(f"access.beta.{purpose}"))
    return float(p.value(f"access.beta.work_{ {'two_wheeler': 'car', 'metro': 'transit'}.get(mode, mode)}"))


def congestion_ratio(origin: Column, destination: Column, new_origin: Column, new_destination: Column, p: Params) -> Column:
    """Factor by which minutes grow as the built-up share at both ends rises."""
    slow = lambda a, b: F.greatest(F.lit(float(p.value("access.congestion.floor"))), 1 - p.value("access.congestion.k") * (a + b) / 2)
    return slow(origin, destination) / slow(new_origin, new_destination)


def band_accessibility(od: DataFrame, opp: DataFrame, origin: str, zone: str, p: Params, ratio: str | None = None) -> DataFrame:
    """(origin, lna_<band>...): one join and one aggregate over the OD table for all bands, modes and purposes.

    Null minutes are unreachable; ratio names a column of od that stretches minutes.
    """
    modes = _modes(p)
    taken = c("minutes") * c(ratio) if ratio else c("minutes")
    here = lambda purpose, mode: F.when((c("mode") == mode) & c("minutes").isNotNull(), F.exp(-beta(p, purpose, mode) * taken) * c(f"o_{purpose}")).otherwise(0.0)
    sums = od.join(opp, zone).groupBy(origin).agg(*[F.sum(here(x, m)).alias(f"a_{x}_{m}") for x in PURPOSES for m in modes])
    return _band_logs(sums, origin, p, lambda x, m: f"a_{x}_{m}")


def band_gravity(pairs: DataFrame, origin: str, kmh: dict[str, float], p: Params) -> DataFrame:
    """What band_accessibility returns, where minutes by mode come from dist_m: a pair is one row for all modes, and
    brings o_<purpose> of its destination; a null dist_m is unreachable. Modes of one speed and decay share a sum.
    Pairs of an origin lie in one task, so partial sums are all there is."""
    rates = {(x, m): (x, beta(p, x, m), float(kmh[m])) for x in PURPOSES for m in _modes(p)}
    names = {r: f"_a{i}" for i, r in enumerate(dict.fromkeys(rates.values()))}
    term = lambda x, b, v: F.exp(-b * minutes(c("dist_m"), v)) * c(f"o_{x}")
    sums = pairs.groupBy(origin).agg(*[F.coalesce(F.sum(term(*r)), F.lit(0.0)).alias(n) for r, n in names.items()])
    return _band_logs(sums, origin, p, lambda x, m: names[rates[x, m]])


def _modes(p: Params) -> list[str]:
    return sorted({m for w in p.value("behaviour.band_modes").values() for m in w})


def _band_logs(sums: DataFrame, origin: str, p: Params, name: Callable[[str, str], str]) -> DataFrame:
    weights = p.value("behaviour.band_modes")
    lna = lambda b: sum((p.value(f"access.purpose_weight.{x}") * F.log1p(sum((w * c(name(x, m)) for m, w in weights[b].items()), F.lit(0.0))) for x in PURPOSES), F.lit(0.0))
    return sums.select(origin, *[lna(b).alias(f"lna_{b}") for b in BANDS])


def utilities(cells: DataFrame, p: Params) -> DataFrame:
    """Adds u_<band>: access, price, amenity, disamenity, households, own band's share, field and alpha.

    Prices that are null or not positive are the median of the others; absent columns field and alpha_<band> count 0;
    a null lna_<band> leaves a null utility, which is no choice.
    """
    rows = cells.join(F.broadcast(quantiles(cells.filter("price > 0"), {"_median": ("price", 0.5)})))  # one row
    price = F.ln(F.when(c("price") > 0, c("price")).otherwise(c("_median")))
    have = set(cells.columns)
    extra = lambda name: F.coalesce(c(name), F.lit(0.0)) if name in have else F.lit(0.0)

    def u(b: str) -> Column:
        k = p.value(f"behaviour.logit_{b}")
        same = F.when(c("households") > 0, c(f"hh_{b}") / F.when(c("households") > 0, c("households"))).otherwise(0.0)
        return (
            k["access"] * c(f"lna_{b}") + k["price"] * price + k["amenity"] * F.coalesce("amenity", F.lit(0.0)) - k["disamenity"] * F.coalesce("disamenity", F.lit(0.0))
            + k["agglom"] * F.ln(c("households") + 1) + k["same"] * same + extra("field") + extra(f"alpha_{b}")
        )

    return rows.select(*cells.columns, *[u(b).alias(f"u_{b}") for b in BANDS])


def choice_shares(cells: DataFrame, eligible: Column) -> DataFrame:
    """Adds share_<band> over eligible cells, 0 elsewhere: two aggregates to one row each."""
    top = cells.agg(*[F.max(F.when(eligible, c(f"u_{b}"))).alias(f"_t_{b}") for b in BANDS])
    rows = cells.join(F.broadcast(top))
    e = lambda b: F.when(eligible, F.exp(c(f"u_{b}") - c(f"_t_{b}"))).otherwise(0.0)
    total = rows.agg(*[F.sum(e(b)).alias(f"_s_{b}") for b in BANDS])
    rows = rows.join(F.broadcast(total))
    return rows.select(*cells.columns, *[F.when(c(f"_s_{b}") > 0, e(b) / F.when(c(f"_s_{b}") > 0, c(f"_s_{b}"))).otherwise(0.0).alias(f"share_{b}") for b in BANDS])


def eligible(prefix: str = "u_") -> Column:
    """Cells whose value is known for every band."""
    out = F.lit(True)
    for b in BANDS:
        out = out & c(f"{prefix}{b}").isNotNull() & ~F.isnan(c(f"{prefix}{b}"))
    return out


def fit_alpha(cells: DataFrame, p: Params) -> DataFrame:
    """(cell, alpha_<band>..., alpha): ln(observed share) - ln(predicted share), centred over eligible cells.

    Cells without observed households or a predicted share take the band's least; a band without any raises. alpha is
    the mean over bands by households, centred too.
    """
    plain = cells.drop(*[f"alpha_{b}" for b in BANDS])
    rows = choice_shares(utilities(plain, p), eligible())
    totals = rows.agg(*[F.sum(f"hh_{b}").alias(f"_h_{b}") for b in BANDS])
    rows = rows.join(F.broadcast(totals))
    usable = lambda b: eligible() & (c(f"hh_{b}") > 0) & (c(f"share_{b}") > 0)
    raw = lambda b: F.when(usable(b), F.ln(c(f"hh_{b}") / c(f"_h_{b}")) - F.ln(F.when(usable(b), c(f"share_{b}"))))
    rows = rows.select("cell", eligible().alias("_ok"), *[c(f"_h_{b}") for b in BANDS], *[raw(b).alias(f"_a_{b}") for b in BANDS])
    least = rows.agg(*[F.min(f"_a_{b}").alias(f"_m_{b}") for b in BANDS])
    rows = rows.join(F.broadcast(least))
    missing = lambda b: F.when(c(f"_m_{b}").isNull(), F.raise_error(F.lit(f"alpha of band {b}: no cell has households and a predicted share")).cast("double"))
    rows = rows.select("cell", "_ok", *[c(f"_h_{b}") for b in BANDS], *[F.coalesce(missing(b), c(f"_a_{b}"), c(f"_m_{b}")).alias(f"_a_{b}") for b in BANDS])
    mean = rows.agg(*[F.avg(F.when(c("_ok"), c(f"_a_{b}"))).alias(f"_c_{b}") for b in BANDS])
    rows = rows.join(F.broadcast(mean)).select("cell", *[c(f"_h_{b}") for b in BANDS], *[(c(f"_a_{b}") - c(f"_c_{b}")).alias(f"alpha_{b}") for b in BANDS])
    every = sum((c(f"_h_{b}") for b in BANDS), F.lit(0.0))
    rows = rows.withColumn("_one", sum((c(f"alpha_{b}") * c(f"_h_{b}") for b in BANDS), F.lit(0.0)) / F.when(every > 0, every))
    centre = rows.agg(F.avg("_one").alias("_centre"))
    return rows.join(F.broadcast(centre)).select("cell", *[f"alpha_{b}" for b in BANDS], (c("_one") - c("_centre")).alias("alpha"))


def wage_band(wage: Column, p: Params) -> Column:
    """Number of the band that a household on this wage is in."""
    return digitize(wage * p.value("behaviour.workers_per_household") * p.value("behaviour.other_income"), p.value("behaviour.income_bounds"))


def active_jobs(effects: DataFrame, year: int, p: Params) -> DataFrame:
    """Employment effects (cell, sector, jobs, wage, start_year, ramp_years, dormitory_share) with active, the jobs
    there are in a year: none up to the start, then rising in equal steps over the ramp."""
    ramp = F.coalesce(F.when(c("ramp_years") > 0, c("ramp_years")), F.lit(float(p.value("credibility.ramp_years"))))
    share = F.when(F.lit(year) <= c("start_year"), 0.0).otherwise(F.least(F.lit(1.0), (F.lit(year) - c("start_year")) / ramp))
    return effects.withColumn("active", c("jobs") * share).filter("active > 0")


def household_demand(cells: DataFrame, effects: DataFrame, year: int, p: Params, growth: float | None = None) -> DataFrame:
    """One row: exogenous, job_driven and demand_<band> households.

    Natural growth is split by the observed mix (equally where none is observed); jobs bring the households of the
    sector's in-migrants who do not live in dormitories, in the band of their wage.
    """
    rate = float(p.value("behaviour.natural_growth_rate")) if growth is None else float(growth)
    held = cells.agg(F.coalesce(F.sum("households"), F.lit(0.0)).alias("_hh"), *[F.coalesce(F.sum(f"hh_{b}"), F.lit(0.0)).alias(f"_h_{b}") for b in BANDS])
    shares = p.value("behaviour.inmigrant_share")
    share = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, float(v))])[c("sector")]
    jobs = active_jobs(effects, year, p)
    made = c("active") * share * (1 - F.coalesce("dormitory_share", F.lit(0.0))) / p.value("behaviour.workers_per_household")
    brought = jobs.select(made.alias("_n"), wage_band(c("wage"), p).alias("_b")).agg(
        *[F.coalesce(F.sum(F.when(c("_b") == i, c("_n"))), F.lit(0.0)).alias(f"_j_{b}") for i, b in enumerate(BANDS)], F.coalesce(F.sum("_n"), F.lit(0.0)).alias("job_driven")
    )
    every = sum((c(f"_h_{b}") for b in BANDS), F.lit(0.0))
    mix = lambda b: F.when(every > 0, c(f"_h_{b}") / F.when(every > 0, every)).otherwise(1.0 / len(BANDS))
    rows = held.join(F.broadcast(brought)).withColumn("exogenous", c("_hh") * rate)
    return rows.select("exogenous", "job_driven", *[(c("exogenous") * mix(b) + c(f"_j_{b}")).alias(f"demand_{b}") for b in BANDS])


def fill_start(cells: DataFrame, demand: DataFrame) -> DataFrame:
    """State before the first round: cells (cell, u_<band>, headroom) with what they got, and the demand left."""
    rows = cells.select("cell", "headroom", *[f"u_{b}" for b in BANDS], (eligible() & (F.coalesce("headroom", F.lit(0.0)) > 0)).alias("active"), F.lit(False).alias("capped"), *[F.lit(0.0).alias(f"got_{b}") for b in BANDS])
    return rows.join(F.broadcast(demand.select(*[c(f"demand_{b}").alias(f"rest_{b}") for b in BANDS])))


def fill_round(state: DataFrame, p: Params) -> DataFrame:
    """One round: active cells share what is left by logit; a cell beyond its headroom gives back what does not fit, all
    bands by the same factor, and closes. Where none is beyond it, nothing is left."""
    sqm = p.value("behaviour.sqm_per_household")
    rows = choice_shares(state, c("active"))
    rows = rows.select("cell", "headroom", *[f"u_{b}" for b in BANDS], "active", "capped", *[(c(f"got_{b}") + c(f"share_{b}") * c(f"rest_{b}")).alias(f"got_{b}") for b in BANDS], *[f"rest_{b}" for b in BANDS])
    used = sum((c(f"got_{b}") * float(sqm[b]) for b in BANDS), F.lit(0.0))
    rows = rows.withColumn("_over", c("active") & (used > c("headroom"))).withColumn("_scale", F.when(c("_over"), c("headroom") / F.when(used > 0, used)).otherwise(1.0))
    # without an active cell nothing was given out, so what was left stays left
    back = rows.agg(F.coalesce(F.bool_or("active"), F.lit(False)).alias("_any"), *[F.coalesce(F.sum(c(f"got_{b}") * (1 - c("_scale"))), F.lit(0.0)).alias(f"_back_{b}") for b in BANDS])
    rows = rows.join(F.broadcast(back))
    return rows.select(
        "cell", "headroom", *[f"u_{b}" for b in BANDS], (c("active") & ~c("_over")).alias("active"), (c("capped") | c("_over")).alias("capped"),
        *[(c(f"got_{b}") * c("_scale")).alias(f"got_{b}") for b in BANDS], *[F.when(c("_any"), c(f"_back_{b}")).otherwise(c(f"rest_{b}")).alias(f"rest_{b}") for b in BANDS],
    )


def allocate_constrained(cells: DataFrame, demand: DataFrame, p: Params, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(cell, got_<band>, capped, rest_<band>): rounds until nothing is left or no cell is open. What cannot be housed
    stays in rest_<band>, the same on every row, and is logged: a finding, not an error. cut writes a round."""
    state = cut(fill_start(cells, demand))
    rest = 0.0
    for _ in range(int(p.value("behaviour.allocation_rounds"))):
        rest, open_ = state.agg(F.max(sum((c(f"rest_{b}") for b in BANDS), F.lit(0.0))), F.bool_or("active")).first()
        if not open_ or not rest or rest <= 0:
            break
        state = cut(fill_round(state, p))
    rest = state.agg(F.max(sum((c(f"rest_{b}") for b in BANDS), F.lit(0.0)))).first()[0] or 0.0
    if rest > 0:
        LOG.warning("%.1f households could not be housed", rest)
    return state


def service_jobs(allocated: DataFrame, p: Params, persons: dict[str, float], dormitory: str | None = None) -> DataFrame:
    """Adds residents and service_jobs: the only place where service employment is made."""
    residents = sum((c(f"got_{b}") * float(persons[b]) for b in BANDS), F.lit(0.0))
    dorm = F.coalesce(c(dormitory), F.lit(0.0)) if dormitory else F.lit(0.0)
    rate = float(p.value("behaviour.service_jobs_per_resident"))
    return allocated.withColumn("residents", residents).withColumn("service_jobs", rate * residents + rate * p.value("behaviour.dormitory_factor") * dorm)


@dataclass
class Allocation:
    """cells with households, bands, population and jobs of the year's end; the loop's record; what was not housed."""

    cells: DataFrame
    iterations: int
    steps: list[float]
    spill: dict[str, float] = field(default_factory=dict)


def allocate(cells: DataFrame, od: DataFrame, zone: str, opportunities: Callable[[DataFrame], DataFrame], effects: DataFrame, year: int, p: Params, cut: Callable[[DataFrame], DataFrame], persons: dict[str, float], growth: float | None = None) -> Allocation:
    """A year's allocation with the agglomeration loop.

    cells: cell, zone, price, amenity, disamenity, households, hh_<band>, jobs, population, headroom, capacity_sqm,
    builtup_frac, alpha_<band>; od: cell, zone, mode, minutes. Each turn allocates, turns residents into service jobs,
    recomputes accessibility with them and with the congestion of what was built, and moves lna a share phi of the way.
    A step beyond the first one raises, as does a loop that has not settled in time.
    """
    start = cut(band_accessibility(od, opportunities(cells), "cell", zone, p))
    lna, demand = start, cut(household_demand(cells, effects, year, p, growth))
    dorm = active_jobs(effects, year, p).groupBy("cell").agg(F.sum(c("active") * F.coalesce("dormitory_share", F.lit(0.0))).alias("dormitory"))
    base = cut(cells.join(dorm, "cell", "left").fillna(0.0, ["dormitory"]))
    sqm, phi, steps = p.value("behaviour.sqm_per_household"), float(p.value("behaviour.spillover_phi")), []
    built = base.select("cell", zone, F.coalesce("builtup_frac", F.lit(0.0)).alias("_b"))
    ends = built.groupBy(zone).agg(F.avg("_b").alias("_bz"))
    for turn in range(1, int(p.value("behaviour.max_iterations")) + 1):
        u = utilities(base.join(lna, "cell", "left"), p)
        got = allocate_constrained(u, demand, p, cut)
        done = cut(service_jobs(base.join(got.drop("headroom", *[f"u_{b}" for b in BANDS]), "cell"), p, persons, "dormitory"))
        share = sum((c(f"got_{b}") * float(sqm[b]) for b in BANDS), F.lit(0.0)) / F.when(c("capacity_sqm") > 0, c("capacity_sqm"))
        now = F.coalesce("builtup_frac", F.lit(0.0))
        new = done.select("cell", zone, F.least(F.lit(1.0), now + F.coalesce(F.least(share, F.lit(1.0)), F.lit(0.0)) * (1 - now)).alias("_n"))
        new_ends = new.groupBy(zone).agg(F.avg("_n").alias("_nz"))
        stretched = od.join(built.select("cell", "_b"), "cell").join(new.select("cell", "_n"), "cell").join(ends, zone).join(new_ends, zone)
        stretched = stretched.withColumn("_ratio", congestion_ratio(c("_b"), c("_bz"), c("_n"), c("_nz"), p))
        raw = band_accessibility(stretched, opportunities(done.withColumn("jobs", c("jobs") + c("service_jobs"))), "cell", zone, p, "_ratio")
        both = lna.join(raw.select("cell", *[c(f"lna_{b}").alias(f"_r_{b}") for b in BANDS]), "cell", "left")
        step = lambda b: phi * F.coalesce(c(f"_r_{b}") - c(f"lna_{b}"), F.lit(0.0))
        moved = cut(both.select("cell", *[(c(f"lna_{b}") + step(b)).alias(f"lna_{b}") for b in BANDS], F.greatest(*[F.abs(step(b)) for b in BANDS]).alias("_step")))
        steps.append(moved.agg(F.max("_step")).first()[0] or 0.0)
        lna = moved.drop("_step")
        if steps[-1] > steps[0]:
            raise ConvergenceError(f"turn {turn}: the step rose to {steps[-1]:g} from {steps[0]:g}")
        if steps[-1] < float(p.value("behaviour.convergence_tol")):
            break
    else:
        raise ConvergenceError(f"no fixed point after {len(steps)} turns: last step {steps[-1]:g}")
    spill = done.agg(*[F.max(f"rest_{b}").alias(b) for b in BANDS]).first().asDict()
    total = sum((c(f"got_{b}") for b in BANDS), F.lit(0.0))
    keep = [x for x in cells.columns if x not in ("households", "population", "jobs", *[f"hh_{b}" for b in BANDS])]
    out = done.join(lna, "cell", "left").select(
        *keep, (c("households") + total).alias("households"), *[(c(f"hh_{b}") + c(f"got_{b}")).alias(f"hh_{b}") for b in BANDS], (c("population") + c("residents")).alias("population"),
        (c("jobs") + c("service_jobs")).alias("jobs"), *[f"got_{b}" for b in BANDS], "residents", "service_jobs", "capped", *[f"lna_{b}" for b in BANDS],
    )
    return Allocation(out, len(steps), steps, spill)
