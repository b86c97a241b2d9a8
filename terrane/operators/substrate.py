"""What a cell can hold: developability, utilities, capacity, headroom, supply elasticity, jobs by area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.scalar import clip, lookup, step_down
from terrane.params import Params
from terrane.schema import SECTORS


def undevelopable(share: Column, slope_pct: Column, p: Params) -> Column:
    steep = F.when(slope_pct > p.value("supply.slope.cutoff_pct"), 1.0).otherwise(0.0)
    return clip(F.coalesce(share, F.lit(0.0)) + steep, 0.0, 1.0)


def slope_cost(slope_pct: Column, p: Params) -> Column:
    over = F.greatest(slope_pct - p.value("supply.slope.penalty_start_pct"), F.lit(0.0))
    return F.when(slope_pct > p.value("supply.slope.cutoff_pct"), F.lit(float("inf"))).otherwise(1 + p.value("supply.slope.penalty_per_pct") * over)


def utility_state(water: Column, sewer: Column, power: Column) -> Column:
    """Most specific first; power without water counts for nothing."""
    return (
        F.when((water == 1) & (sewer == 1) & (power == 1), "water_sewer_power")
        .when((water == 1) & (sewer == 1), "water_sewer").when(water == 1, "water").otherwise("none")
    )


def utility_gate(state: Column, p: Params) -> Column:
    return lookup(state, {k: p.value(f"supply.utility_gate.{k}") for k in ("none", "water", "water_sewer", "water_sewer_power")})


def assembly_factor(parcel_sqm: Column, p: Params) -> Column:
    steps = p.value("supply.assembly_steps")
    return step_down(parcel_sqm, steps, float(steps[-1][1]))


def elasticity_class(builtup: Column, headroom_ratio: Column, undev: Column, water: Column, p: Params) -> Column:
    """Dense, then constrained, then open fringe, else typical; the city's default where an input is null."""
    c = lambda k: p.value(f"supply.classifier.{k}")
    unknown = builtup.isNull() | headroom_ratio.isNull() | undev.isNull() | water.isNull()
    return (
        F.when(unknown, c("default_class"))
        .when((builtup > c("dense_builtup_min")) & (headroom_ratio < c("dense_headroom_ratio_max")), "dense_core")
        .when(undev > c("constrained_undevelopable_min"), "constrained_periph")
        .when((builtup < c("open_builtup_max")) & (water == 0), "open_fringe").otherwise("typical_periph")
    )


def elasticity(name: Column, p: Params) -> Column:
    return lookup(name, {k: p.value(f"supply.elasticity.{k}") for k in ("dense_core", "constrained_periph", "typical_periph", "open_fringe")})


def substrate(cells: DataFrame, p: Params) -> DataFrame:
    """Adds undev, slope_cost, utility_state, capacity_sqm, headroom_sqm, elasticity_class and eps to every cell."""
    c = F.col
    out = cells.withColumn("undev", undevelopable(c("undevelopable_frac"), c("slope_pct"), p)).withColumn("slope_cost", slope_cost(c("slope_pct"), p))
    out = out.withColumn("utility_state", utility_state(c("util_water"), c("util_sewer"), c("util_power")))
    capacity = c("area_sqm") * (1 - c("undev")) * c("permitted_far") * utility_gate(c("utility_state"), p) * assembly_factor(c("mean_parcel_sqm"), p)
    out = out.withColumn("capacity_sqm", F.greatest(F.lit(0.0), capacity))
    out = out.withColumn("headroom_sqm", F.greatest(F.lit(0.0), c("capacity_sqm") - c("res_sqm") - c("com_sqm")))
    out = out.withColumn("elasticity_class", elasticity_class(c("builtup_frac"), c("headroom_sqm") / c("area_sqm"), c("undev"), c("util_water"), p))
    return out.withColumn("eps", elasticity(c("elasticity_class"), p))


def ward_jobs(cells: DataFrame, wards: DataFrame, growth: dict[str, float], poi: dict[str, str], ward: str = "ward", floorspace: str = "com_sqm") -> DataFrame:
    """cells with jobs_by_sector, an array in the order of SECTORS: each ward's jobs of a sector, grown, among its cells.

    wards (ward, sector, jobs). A cell's weight in a sector is its commercial floorspace, times its points of interest
    where poi names a column for the sector; where a ward's weights sum to 0 its cells share equally. Cells of wards
    without jobs have 0. A ward that no cell is in, and a sector that is none, raise. Sums are one partial aggregate by
    ward; the table that joins back has a row for each ward.
    """
    c = F.col
    lost = wards.select(ward).distinct().join(cells.select(ward).distinct(), ward, "left_anti").orderBy(ward).limit(5).collect()
    if lost:
        raise ValueError(f"wards without cells: {', '.join(str(r[0]) for r in lost)}")
    odd = wards.filter(~F.coalesce(c("sector").isin(*SECTORS), F.lit(False))).select("sector").distinct().limit(5).collect()
    if odd:
        raise ValueError(f"unknown sectors: {sorted(str(r[0]) for r in odd)}")

    def weight(sector: str) -> Column:
        plain = c(floorspace).cast("double") * (c(poi[sector]) if sector in poi and poi[sector] in cells.columns else F.lit(1.0))
        return F.greatest(F.lit(0.0), F.when(~F.isnan(plain), plain).otherwise(0.0))

    weights = {s: f"_w{i}" for i, s in enumerate(SECTORS)}
    rows = cells.withColumns({name: F.coalesce(weight(s), F.lit(0.0)) for s, name in weights.items()})
    held = rows.groupBy(ward).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(name).alias(f"_t{name}") for name in weights.values()])
    totals = wards.groupBy(ward).agg(*[(F.sum(F.when(c("sector") == s, c("jobs"))) * float(growth.get(s, 1.0))).alias(f"_j{name}") for s, name in weights.items()])
    joined = rows.join(held.join(totals, ward), ward, "left")

    def jobs(name: str) -> Column:
        total = c(f"_t{name}")
        share = F.when(total > 0, c(name) / F.when(total > 0, total)).otherwise(1.0 / c("_n"))
        return F.coalesce(c(f"_j{name}") * share, F.lit(0.0))

    return joined.withColumn("jobs_by_sector", F.array(*[jobs(name) for name in weights.values()])).select(*[x for x in cells.columns if x != "jobs_by_sector"], "jobs_by_sector")


def assemble(cells: DataFrame, p: Params, wards: DataFrame | None = None, growth: dict[str, float] | None = None, poi: dict[str, str] | None = None, ward: str = "ward", fit: dict[str, float] | None = None) -> DataFrame:
    """The layer's one entry: substrate(), elasticities by a regression where one is given, and jobs of wards.

    Without wards, jobs_by_sector stays as it is: no employment is made up.
    """
    out = substrate(cells, p)
    if fit is not None:
        out = regressed_elasticity(out.drop("eps"), fit)
    return out if wards is None else ward_jobs(out, wards, growth or {}, poi or {}, ward)


def spread_by_weight(df: DataFrame, group: str, total: Column, weight: Column, out: str) -> DataFrame:
    """A group's total shared among its rows by weight, or equally where the group's weights sum to 0."""
    w = Window.partitionBy(group)
    held = F.sum(weight).over(w)
    share = F.when(held > 0, weight / F.when(held > 0, held)).otherwise(1.0 / F.count(F.lit(1)).over(w))
    return df.withColumn(out, total * share)


def fit_log_elasticity(zones: DataFrame, y: str, xs: list[str], min_abs: float) -> dict[str, float]:
    """OLS of y on xs with intercept, over rows with |y| >= min_abs: one aggregate of the Gram matrix, solved here."""
    import numpy as np

    rows = zones.filter(F.abs(y) >= min_abs).dropna(subset=[y, *xs])
    cols = [F.lit(1.0), *[F.col(x) for x in xs]]
    sums = [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]] + [F.sum(a * F.col(y)) for a in cols] + [F.sum(F.col(y) * F.col(y)), F.count(F.lit(1))]
    got = [float(v or 0) for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    k = len(cols)
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = got[: k * (k + 1) // 2]
    gram = gram + np.triu(gram, 1).T
    right = np.array(got[k * (k + 1) // 2 : -2])
    beta = np.linalg.lstsq(gram, right, rcond=None)[0]
    yy, n = got[-2:]
    tss = yy - right[0] ** 2 / n if n else 0.0
    return dict(zip(["intercept", *xs], map(float, beta))) | {"r2": 1 - (yy - float(beta @ right)) / tss if tss else float("nan"), "n": n}


#: Terms of the elasticity regression, in order after the constant.
TERMS = ("_open", "regulatory_index", "_unbuilt", "_parcel")


def _design(rows: DataFrame, offset: float) -> DataFrame:
    c = F.col
    return rows.withColumn("_open", F.ln(1 - c("undevelopable_frac") + offset)).withColumn("_unbuilt", F.ln(1 - c("builtup_frac") + offset)).withColumn("_parcel", F.when(c("mean_parcel_sqm") > 0, F.ln(F.when(c("mean_parcel_sqm") > 0, c("mean_parcel_sqm")))))


def fit_elasticity(zones: DataFrame, min_abs: float, offset: float = 0.01) -> dict[str, float]:
    """Log elasticity on developable share, regulation, open land and parcel size, with r2 and n.

    zones: dln_price, dln_floorspace, undevelopable_frac, regulatory_index, builtup_frac, mean_parcel_sqm. Zones whose
    price hardly moved, or whose elasticity is not positive, are left out; none left raises.
    """
    c = F.col
    moved = _design(zones, offset).filter(F.abs("dln_price") >= min_abs).withColumn("_e", c("dln_floorspace") / c("dln_price")).filter("_e > 0")
    got = fit_log_elasticity(moved.withColumn("_y", F.ln("_e")), "_y", list(TERMS), 0.0)
    if not got["n"]:
        raise ValueError("no zone can be fitted")
    return got


def regressed_elasticity(cells: DataFrame, fit: dict[str, float], offset: float = 0.01) -> DataFrame:
    """cells with eps by a fit; a term it lacks raises."""
    lost = [x for x in ("intercept", *TERMS) if fit.get(x) is None]
    if lost:
        raise ValueError(f"the fit lacks {lost}")
    rows = _design(cells, offset)
    value = sum((float(fit[x]) * F.col(x) for x in TERMS), F.lit(float(fit["intercept"])))
    return rows.withColumn("eps", F.exp(value)).drop("_open", "_unbuilt", "_parcel")


def refine_population(pieces: DataFrame, cells: DataFrame, least: float, ward: str = "ward", people: str = "people") -> DataFrame:
    """(cell, population, unweighted) from pieces (ward, people, cell, area): a cell belongs to the ward that it shares
    most area with (of equal ones the last by name), and a ward's people go to its cells by their floorspace; by area, and flagged, where a ward has too
    little of it. cells (cell, weight); cells in no ward have nobody."""
    c = F.col
    best = pieces.groupBy("cell").agg(F.max(F.struct("area", F.col(ward).alias("ward"), F.col(people).alias("people"))).alias("b"))
    rows = best.select("cell", "b.ward", "b.people", "b.area").join(cells.select("cell", F.coalesce("weight", F.lit(0.0)).alias("_w")), "cell")
    held = rows.groupBy("ward").agg(F.sum("_w").alias("_tw"), F.sum("area").alias("_ta"))
    thin = c("_tw") < least
    share = F.when(thin, c("area") / F.when(c("_ta") > 0, c("_ta"))).otherwise(c("_w") / F.when(c("_tw") > 0, c("_tw")))
    got = rows.join(held, "ward").select("cell", (c("people") * share).alias("_p"), thin.alias("_t"))
    return cells.select("cell").join(got, "cell", "left").select("cell", F.coalesce("_p", F.lit(0.0)).alias("population"), F.coalesce("_t", F.lit(False)).alias("unweighted"))
