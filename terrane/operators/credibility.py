"""How likely an announced project is: announcer score, completion probability, delay, activation over years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import normal
from terrane.functions.scalar import clip, lookup, normal_quantile, step_down, step_up
from terrane.params import ParamError, Params


class CommitmentError(ValueError):
    """A private project says nothing about its commitment, or something unknown."""


def delivery_score(ratio: Column, p: Params) -> Column:
    return step_down(ratio, p.value("credibility.delivery_bands"), float(p.value("credibility.delivery_unknown")))


def lag_score(slip_months: Column, p: Params) -> Column:
    return F.coalesce(clip(1 - slip_months / p.value("credibility.lag_months"), 0.0, 1.0), F.lit(float(p.value("credibility.missing_score"))))


def capacity_score(capex: Column, mean_capex: Column, p: Params) -> Column:
    usable = capex.isNotNull() & (mean_capex > 0)
    missing = F.lit(float(p.value("credibility.missing_score")))
    return F.when(usable, step_up(capex / F.when(mean_capex > 0, mean_capex), p.value("credibility.capacity_bands"), missing)).otherwise(missing)


def cycle_score(p: Params, utilisation: Column | None = None, mean: float = 0.0, sd: float = 1.0) -> Column:
    """1 - clip(centre + spread * z): high capacity utilisation at the announcement scores lower; null counts z = 0."""
    if sd <= 0:
        raise ValueError("sd must be positive")
    z = F.lit(0.0) if utilisation is None else F.coalesce((utilisation - mean) / sd, F.lit(0.0))
    return 1 - clip(p.value("credibility.cycle_centre") + p.value("credibility.cycle_spread") * z, 0.0, 1.0)


def check_commitment(projects: DataFrame, p: Params) -> DataFrame:
    """projects, if every private one has a known form of commitment; one aggregate."""
    known = sorted(p.value("credibility.hardness"))
    private = ~F.col("is_public")
    form = F.col("commitment_form")
    got = projects.agg(F.count_if(private & form.isNull()).alias("none"), F.count_if(private & form.isNotNull() & ~form.isin(*known)).alias("odd")).first()
    if got["none"] or got["odd"]:
        raise CommitmentError(f"{got['none']} private projects without a form of commitment, {got['odd']} with an unknown one")
    return projects


def announcer_score(scores: dict[str, Column], p: Params) -> Column:
    """Weighted mean of the component scores, stretched to [low, high]."""
    weights = p.value("credibility.score_weights")
    raw = sum((weights[k] * s for k, s in scores.items()), F.lit(0.0)) / sum(weights[k] for k in scores)
    low, high = p.value("credibility.score_low"), p.value("credibility.score_high")
    return low + raw * (high - low)


def modifier_product(modifiers: Column, table: dict[str, float]) -> Column:
    """Product over an array of names; unknown names count 1."""
    names = F.create_map(*[F.lit(v) for k, x in table.items() for v in (k, float(x))])
    return F.aggregate(modifiers, F.lit(1.0), lambda a, m: a * F.coalesce(F.try_element_at(names, m), F.lit(1.0)))


def completion(projects: DataFrame, announcers: DataFrame, p: Params) -> DataFrame:
    """Adds acs and p_completion. Cap, then physical divergence, then abandonment, in that order."""
    c = F.col
    rows = projects.join(announcers, "announcer_id", "left")
    hard = lookup(c("commitment_form"), p.value("credibility.hardness"))
    scores = {
        "delivery": delivery_score(c("delivery_ratio"), p), "lag": lag_score(c("median_slip_months"), p),
        "capacity": capacity_score(c("capex"), c("mean_capex"), p), "hardness": hard, "cycle": cycle_score(p, c("capacity_util") if "capacity_util" in projects.columns else None),
    }
    rows = rows.withColumn("acs", announcer_score(scores, p))
    base = F.when(c("is_public"), lookup(c("stage"), p.value("credibility.stage"))).otherwise(hard * c("acs"))
    rows = rows.withColumn("p_completion", F.least(base * modifier_product(c("modifiers"), p.value("credibility.p_mult")), F.lit(float(p.value("credibility.p_cap")))))
    idle = c("claims_construction") & c("physical_state").isin("none", "cleared") & (c("physical_age_days") < p.value("credibility.divergence_days"))
    rows = rows.withColumn("p_completion", F.when(idle, c("p_completion") * p.value("credibility.divergence_mult")).otherwise(c("p_completion")))
    return rows.withColumn("p_completion", F.when(c("abandoned"), 0.0).otherwise(c("p_completion")))


def activation(projects: DataFrame, years: DataFrame, p: Params) -> DataFrame:
    """p * phase(t) * discount(t) of each project and year; years is a handful of rows."""
    c = F.col
    f = p.value("credibility.phase")
    ramp = F.least(F.greatest((c("year") - c("open_year")) / p.value("credibility.ramp_years"), F.lit(0.0)), F.lit(1.0))
    phase = (
        F.when((c("year") < c("announced_year")) | c("open_year").isNull(), 0.0).when(c("year") < c("construction_year"), f["announced"])
        .when(c("year") < c("open_year"), f["announced"] + f["construction"]).otherwise(f["announced"] + f["construction"] + f["operation"] * ramp)
    )
    discount = F.when(c("year") < c("open_year"), F.pow(F.lit(1 + p.value("credibility.discount")), c("year") - c("open_year"))).otherwise(1.0)
    return projects.join(F.broadcast(years)).withColumn("weight", c("p_completion") * phase * discount)


def slip_median(family: dict) -> float:
    """Median of a lognormal slip, or of an atom with a lognormal tail."""
    import math

    if "fast_p" not in family:
        return family["median"]
    if family["fast_p"] >= 0.5:
        return family["fast_slip"]
    tail = family["slow_slip"] * math.exp(family["sigma"] * normal_quantile((0.5 - family["fast_p"]) / (1 - family["fast_p"])))
    return max(tail, family["fast_slip"])


def slip_cdf(family: dict, x: Column) -> Column:
    """P(slip <= x): a lognormal, or an atom at fast_slip with a lognormal tail."""
    law = lambda middle: F.when(x > 0, normal.cdf((F.ln(F.when(x > 0, x)) - F.ln(F.lit(float(middle)))) / family["sigma"])).otherwise(0.0)
    if "fast_p" not in family:
        return clip(law(family["median"]), 0.0, 1.0)
    fast = F.when(x >= family["fast_slip"], F.lit(float(family["fast_p"]))).otherwise(0.0)
    return clip((1 - family["fast_p"]) * law(family["slow_slip"]) + fast, 0.0, 1.0)


def slip_sample(family: Column, p: Params, seed: int, *labels: Column) -> Column:
    """A slip drawn for each row by the seed and labels, from the family that a column names."""
    u, v = normal.uniform(seed, "slip", *labels), normal.uniform(seed, "fast", *labels)
    z, out = normal.quantile(u), F.raise_error(F.concat(F.lit("no delay family "), F.coalesce(family, F.lit("null")))).cast("double")
    for name, f in p.value("credibility.delay_families").items():
        drawn = F.exp(F.ln(F.lit(float(f.get("median", f.get("slow_slip"))))) + f["sigma"] * z)
        drawn = F.when(v < f["fast_p"], F.lit(float(f["fast_slip"]))).otherwise(drawn) if "fast_p" in f else drawn
        out = F.when(family == name, drawn).otherwise(out)
    return out


def delayed(projects: DataFrame, families: dict[str, str], p: Params, seed: int | None = None, forced: dict[str, str] | None = None, draw: str | None = None) -> DataFrame:
    """Adds delay_family, announced_years, slip, actual_years and open_year.

    projects: project_id, archetype, announced_date, stated_completion, modifiers; families maps archetypes to delay
    families, and an archetype without one raises. Without a seed the slip is the family's median; with one it is drawn
    by (seed, draw column, project). Modifiers multiply it. forced: 'happens' keeps the stated date, 'fails' never opens.
    """
    c = F.col
    table = p.value("credibility.delay_families")
    bad = sorted({f for f in families.values() if f not in table}) or sorted({v for v in (forced or {}).values() if v not in ("happens", "fails")})
    if bad:
        raise ParamError(f"unknown families or states {bad}")
    named = F.create_map(*[F.lit(x) for k, v in families.items() for x in (k, v)])
    family = F.coalesce(F.try_element_at(named, c("archetype")), F.raise_error(F.concat(F.lit("no delay family for "), F.coalesce("archetype", F.lit("null")))))
    out = projects.withColumn("delay_family", family)
    if seed is None:
        slip = lookup(c("delay_family"), {k: slip_median(f) for k, f in table.items()})
    else:
        slip = slip_sample(c("delay_family"), p, seed, *([c(draw)] if draw else []), c("project_id"))
    out = out.withColumn("slip", slip * modifier_product(F.coalesce("modifiers", F.array().cast("array<string>")), p.value("credibility.delay_mult")))
    states = F.create_map(*[F.lit(x) for k, v in (forced or {"": "none"}).items() for x in (k, v)])
    out = out.withColumn("_forced", F.coalesce(F.try_element_at(states, c("project_id").cast("string")), F.lit("")))
    out = out.withColumn("slip", F.when(c("_forced") == "happens", 0.0).otherwise(c("slip"))).withColumn("announced_years", announced_years(c("announced_date"), c("stated_completion")))
    out = out.withColumn("actual_years", F.when(c("_forced") != "fails", c("announced_years") * (1 + c("slip"))))
    return out.withColumn("open_year", F.year("announced_date") + c("actual_years")).drop("_forced")


def announced_years(announced: Column, completion_date: Column) -> Column:
    """Duration in anniversary years."""
    return F.datediff(completion_date, announced) / F.datediff(F.add_months(announced, 12), announced)
