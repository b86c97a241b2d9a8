"""Supply, allocation and price: absorption, logit shares, constrained fill, clearing, overshoot, attribution."""

from __future__ import annotations

import logging

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.normal import uniform
from terrane.functions.scalar import clip
from terrane.operators.measures import quantiles, running_total
from terrane.params import ParamError, Params

LOG = logging.getLogger(__name__)


def damping(inventory_months: Column, p: Params) -> Column:
    ratio = p.value("supply.absorption.inventory_cap_months") / F.greatest(inventory_months, F.lit(1.0))
    return clip(F.pow(ratio, F.lit(float(p.value("supply.absorption.damping_exponent")))), 0.0, 1.0)


def absorption_cap(history: Column, years: Column, attractiveness: Column, damp: Column, p: Params) -> Column:
    return F.greatest(F.lit(0.0), history * F.pow(F.lit(1 + p.value("supply.absorption.base_growth")), years) * attractiveness * damp)


def softmax(df: DataFrame, utility: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Shares by exp(utility), shifted by the largest: an aggregate and a join, no window over all rows. Null gets 0."""
    by = by or []
    top = df.groupBy(*by).agg(F.max(utility).alias("_top"))
    join = (lambda a, b: a.join(b, by)) if by else (lambda a, b: a.join(F.broadcast(b)))
    shifted = join(df, top).withColumn("_e", F.coalesce(F.exp(F.col(utility) - F.col("_top")), F.lit(0.0)))
    total = shifted.groupBy(*by).agg(F.sum("_e").alias("_sum"))
    return join(shifted, total).withColumn(out, F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def deliver(cells: DataFrame) -> DataFrame:
    """delivered = min(demand + backlog, cap, headroom), what of it serves backlog, and the backlog left."""
    c = F.col
    out = cells.withColumn("delivered", F.greatest(F.lit(0.0), F.least(c("demand") + c("backlog"), c("cap"), F.greatest(F.lit(0.0), c("capacity_sqm") - c("built")))))
    out = out.withColumn("to_backlog", F.least(c("delivered"), c("backlog")))
    return out.withColumn("backlog_left", c("demand") + c("backlog") - c("delivered"))


def utility(cells: DataFrame, coefficients: dict[str, float], out: str) -> DataFrame:
    """Logit utility of a band; a price that is null or not positive is the median of the others."""
    c = F.col
    median = quantiles(cells.filter(c("price") > 0), {"_median": ("price", 0.5)})
    rows = cells.join(F.broadcast(median)).withColumn("_price", F.when(c("price") > 0, c("price")).otherwise(c("_median")))
    k = coefficients
    value = (
        k["access"] * c("lna") + k["price"] * F.ln("_price") + k["amenity"] * c("amenity") - k["disamenity"] * c("disamenity") + k["agglom"] * F.ln(c("households") + 1)
        + k["same"] * F.when(c("households") > 0, c("band_households") / F.when(c("households") > 0, c("households"))).otherwise(0.0)
    )
    return rows.withColumn(out, value).drop("_median", "_price")


def fill_round(state: DataFrame, sqm: float) -> DataFrame:
    """One round of the capacity-constrained fill: (cell, share weight, active, headroom, got, rest demand) to the next.

    Active cells share the rest by weight; a cell beyond its headroom keeps what fits and closes.
    """
    c = F.col
    total = state.agg(F.sum(F.when(c("active"), c("weight")).otherwise(0.0)).alias("_w"))
    out = state.join(F.broadcast(total))
    share = F.when(c("active") & (c("_w") > 0), c("weight") / F.when(c("_w") > 0, c("_w"))).otherwise(0.0)
    out = out.withColumn("_want", c("got") + share * c("rest")).withColumn("_room", c("headroom") / sqm)
    out = out.withColumn("_new", F.least("_want", "_room"))
    spill = out.agg(F.sum(c("_want") - c("_new")).alias("_spill"))
    out = out.withColumn("active", c("active") & (c("_want") <= c("_room"))).withColumn("got", c("_new"))
    return out.drop("_w", "_want", "_room", "_new", "rest").join(F.broadcast(spill)).withColumnRenamed("_spill", "rest")


def fill(cells: DataFrame, demand: float, sqm: float, cut, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """Rounds until nothing is left over or every cell is closed; cut writes a round and reads it again. What cannot be
    placed stays in rest, the same on every row, and is logged."""
    state = cells.withColumn("active", F.lit(True)).withColumn("got", F.lit(0.0)).withColumn("rest", F.lit(float(demand)))
    for _ in range(rounds):
        state = cut(fill_round(state, sqm))
        rest, active = state.agg(F.max("rest"), F.max(F.col("active").cast("int"))).first()
        if not active or rest <= tolerance:
            break
    rest = state.agg(F.max("rest")).first()[0] or 0.0
    if rest > tolerance:
        LOG.warning("%.1f households could not be housed", rest)
    return state


def demand_shift(d_lna: Column, households: Column, new: Column, field: Column, p: Params) -> Column:
    growth = F.when(households > 0, F.ln((households + new) / F.when(households > 0, households))).otherwise(0.0)
    return p.value("price.gamma") * d_lna + growth + clip(field, p.value("price.field_low"), p.value("price.field_high"))


def supply_shift(quantity: Column, delta: Column) -> Column:
    return F.when(quantity > 0, F.ln(F.greatest(quantity + delta, F.lit(1e-9)) / F.when(quantity > 0, quantity))).otherwise(0.0)


def clear_market(cells: DataFrame, p: Params, phi: float) -> DataFrame:
    """Adds d_ln_p and d_ln_q. The free solution first; where it passes the ceiling, quantity is held there."""
    c = F.col
    eta = float(p.value("price.eta"))
    ceiling = c("quantity") + F.least("headroom_sqm", "cap")
    out = cells.withColumn("_p0", (c("d_ln_d") - c("d_ln_s0")) / (eta + c("eps"))).withColumn("_q0", c("eps") * c("_p0") + c("d_ln_s0"))
    out = out.withColumn("_ceiling", F.when(c("quantity") > 0, F.ln(ceiling / F.when(c("quantity") > 0, c("quantity")))))
    held = c("_q0") > c("_ceiling")
    out = out.withColumn("d_ln_q", F.when(c("quantity") <= 0, 0.0).when(held, c("_ceiling")).otherwise(c("_q0")))
    out = out.withColumn("constrained", F.coalesce(held, F.lit(False)))
    price = F.when(c("quantity") <= 0, c("d_ln_d") / eta).when(held, (c("d_ln_d") - c("d_ln_q")) / eta).otherwise(c("_p0"))
    return out.withColumn("d_ln_p", phi + price).drop("_p0", "_q0", "_ceiling")


def overshoot(shock: Column, since: Column, p: Params) -> Column:
    live = (shock > p.value("price.overshoot_trigger")) & (since >= 0)
    return F.when(live, p.value("price.overshoot_peak") * shock * F.pow(F.lit(0.5), since / p.value("price.overshoot_half_life"))).otherwise(0.0)


def attribute(runs: DataFrame, key: str, factors: list[str], p: Params) -> DataFrame:
    """Leave-one-out: raw effect of each factor, what they leave unexplained, and effects scaled to the total.

    runs is long (key, scenario, value), scenario `full`, `base` or `no_<factor>`: one pivot for all scenarios.
    """
    c = F.col
    at = lambda s: F.max(F.when(c("scenario") == s, c("value")))
    wide = runs.groupBy(key).agg((at("full") - at("base")).alias("total"), *[(at("full") - at(f"no_{f}")).alias(f"raw_{f}") for f in factors])
    summed = sum((c(f"raw_{f}") for f in factors), F.lit(0.0))
    scale = c("total") / F.greatest(summed, F.lit(float(p.value("price.normaliser_floor"))))
    return wide.select(key, "total", (c("total") - summed).alias("interaction"), *[(c(f"raw_{f}") * scale).alias(f"lambda_{f}") for f in factors])


def overheat(cells: DataFrame, p: Params) -> DataFrame:
    """Flags and score: residual above its percentile, yield below its floor, and price growth beyond what is built.

    The third needs price_cagr, builtup_cagr and light_cagr; where a table has none of them, or a value is null, it
    does not hold. The score counts the flags; score_max is one less without a rent.
    """
    c = F.col
    cut = quantiles(cells, {"_cut": ("residual", float(p.value("price.residual_percentile")))})
    out = cells.join(F.broadcast(cut)).withColumn("flag_residual", c("residual") > c("_cut"))
    out = out.withColumn("flag_yield", c("rent") * 12 / c("price") < p.value("price.yield_min"))
    score = F.coalesce(c("flag_residual").cast("int"), F.lit(0)) + F.coalesce(c("flag_yield").cast("int"), F.lit(0))
    n = 2
    if {"price_cagr", "builtup_cagr", "light_cagr"} <= set(cells.columns):
        grown = (c("price_cagr") > p.value("price.physical_ratio") * F.greatest("builtup_cagr", "light_cagr")) & (c("price_cagr") > p.value("price.physical_min_cagr"))
        out = out.withColumn("flag_physical", F.coalesce(grown, F.lit(False)))
        score, n = score + c("flag_physical").cast("int"), 3
    return out.withColumn("score", score).withColumn("score_max", F.when(c("flag_yield").isNull(), n - 1).otherwise(n)).drop("_cut")


def ensemble_quantiles(draws: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row for each (key, quantile)."""
    q = draws.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(x) for x in at])).alias("q"))
    return q.select(*by, F.posexplode("q").alias("_i", "value")).withColumn("quantile", F.element_at(F.array(*[F.lit(x) for x in at]), F.col("_i") + 1)).drop("_i")


def outperformance(draws: DataFrame, draw: str, key: str, value: str) -> DataFrame:
    """Share of draws in which a cell is above its draw's median, and in its top tenth; null where it has no value."""
    cuts = draws.groupBy(draw).agg(F.median(value).alias("_m"), F.percentile(value, F.lit(0.9)).alias("_d"))
    rows = draws.join(cuts, draw)
    return rows.groupBy(key).agg(F.avg((F.col(value) > F.col("_m")).cast("double")).alias("p_outperform"), F.avg((F.col(value) >= F.col("_d")).cast("double")).alias("p_top_decile"))


def price_paths(cells: DataFrame, draws: DataFrame, years: list[int], base_year: int, p: Params, seed: int, macro: str = "base", law: Callable[..., Column] = uniform) -> DataFrame:
    """(draw, cell, year, log_change): cumulative log price change since the base year, of the years named.

    cells: cell, eps, quantity, headroom_sqm, cap, households, and d_lna, new_hh and field where they are not 0. Every
    year redraws trend, access elasticity and demand elasticity between their bounds from (seed, draw, year) by law, clears
    the market and adds up. The columns for all years of a draw are made from its few numbers, so the plan is one join
    of cells and draws and one explode; nothing is shuffled but the result of a later aggregate.
    """
    if not years or years != sorted(years) or years[0] <= base_year:
        raise ValueError("years must rise and follow the base year")
    c = F.col
    have = set(cells.columns)
    part = lambda name: F.coalesce(c(name), F.lit(0.0)) if name in have else F.lit(0.0)
    grown = F.when(c("households") > 0, F.ln((c("households") + part("new_hh")) / F.when(c("households") > 0, c("households")))).otherwise(0.0)
    rest = grown + clip(part("field"), p.value("price.field_low"), p.value("price.field_high"))
    ceiling = F.when(c("quantity") > 0, F.ln((c("quantity") + F.least(c("headroom_sqm"), c("cap") if "cap" in have else c("headroom_sqm"))) / F.when(c("quantity") > 0, c("quantity"))))

    def drawn(path: str, year: Column) -> Column:
        leaf = p.leaf(path)
        low, high = leaf.get("low"), leaf.get("high")
        return F.lit(float(p.value(path))) if low is None or high is None else float(low) + float(high - low) * law(seed, path, c("draw").cast("long"), year.cast("long"))

    last = years[-1]
    steps = F.transform(F.sequence(F.lit(base_year + 1), F.lit(last)), lambda y: F.struct(y.alias("year"), drawn(f"price.phi_{macro}", y).alias("phi"), drawn("price.gamma", y).alias("gamma"), drawn("price.eta", y).alias("eta")))
    per = draws.select("draw", steps.alias("_steps"))
    rows = cells.select("cell", "eps", "quantity", part("d_lna").alias("_a"), rest.alias("_r"), ceiling.alias("_top")).join(per)

    def change(s: Column) -> Column:
        demand = s["gamma"] * c("_a") + c("_r")
        free = c("eps") * demand / (s["eta"] + c("eps"))
        held = F.coalesce(free > c("_top"), F.lit(False))
        return s["phi"] + F.when(c("quantity") <= 0, demand / s["eta"]).when(held, (demand - c("_top")) / s["eta"]).otherwise(demand / (s["eta"] + c("eps")))

    moves = rows.select("draw", "cell", F.transform("_steps", lambda s: F.struct(s["year"].alias("year"), change(s).alias("move"))).alias("_m"))
    upto = lambda y: F.aggregate(F.filter("_m", lambda m: m["year"] <= y), F.lit(0.0), lambda a, m: a + m["move"])
    each = F.explode(F.array(*[F.struct(F.lit(y).cast("long").alias("year"), upto(y).alias("log_change")) for y in years]))
    return moves.select("draw", "cell", each.alias("y")).select("draw", "cell", "y.year", "y.log_change")


def effects_of_year(effects: DataFrame, year: int, capacity: Column) -> DataFrame:
    """(cell, delta, capacity): what starts in a year, and the capacity that is left, never below zero."""
    out = effects.filter(F.col("start_year") == year).groupBy("cell").agg(F.sum("delta").alias("delta"))
    return out.withColumn("capacity", F.greatest(F.lit(0.0), capacity - F.col("delta")))


def delivery_split(delivered: Column, res: Column, com: Column) -> tuple[Column, Column]:
    """What is delivered, split by the standing shares; all residential where nothing stands."""
    total = res + com
    share = F.when(total > 0, res / F.when(total > 0, total)).otherwise(1.0)
    return delivered * share, delivered * (1 - share)


def firm_shares(cells: DataFrame, coefficients: dict[str, float | None], jobs: float, open_to: Column) -> DataFrame:
    """(cell, jobs) that firms bring to cells open to them, by logit; a coefficient that is null raises."""
    lost = sorted(k for k, v in coefficients.items() if v is None)
    if lost:
        raise ParamError(f"firm logit needs {lost}")
    u = sum((float(v) * F.col(k) for k, v in coefficients.items()), F.lit(0.0))
    return softmax(cells.filter(open_to).withColumn("_u", u), "_u", "_s").select("cell", (jobs * F.col("_s")).alias("jobs"))


def land_prices(d_ln_p: Column, multiple: float) -> Column:
    """Log change of land, which moves by a multiple of what stands on it."""
    return multiple * d_ln_p


def residuals(panel: DataFrame, base: DataFrame, last: int, key: str = "cell") -> DataFrame:
    """(key, ln_price, explained, residual) of the last year: log price less the base year's and all moves since.

    panel: key, year, price, d_ln_p; base: key, price. Cells without a price in either have a null residual.
    """
    c = F.col
    at = F.max(F.when(c("year") == last, F.when(c("price") > 0, F.ln(F.when(c("price") > 0, c("price"))))))
    moved = panel.filter(c("year") <= last).groupBy(key).agg(F.sum("d_ln_p").alias("_moves"), at.alias("ln_price"))
    start = base.select(key, F.when(c("price") > 0, F.ln(F.when(c("price") > 0, c("price")))).alias("_start"))
    out = moved.join(start, key, "left").withColumn("explained", c("_start") + c("_moves"))
    return out.select(key, "ln_price", "explained", (c("ln_price") - c("explained")).alias("residual"))


def running_fill(cells: DataFrame, score: str, key: str, room: str, budget: float, by: list[str]) -> DataFrame:
    """Greedy fill in descending score, ties by key: what each cell takes of the budget, by group."""
    before = F.coalesce(F.sum(room).over(Window.partitionBy(*by).orderBy(F.desc(score), key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return cells.withColumn("take", F.greatest(F.lit(0.0), F.least(F.col(room), F.lit(float(budget)) - before)))


def greedy_fill(cells: DataFrame, score: str, key: str, room: str, budget: float) -> DataFrame:
    """running_fill over all cells: no task orders all of them."""
    rows = running_total(cells.withColumn("_down", -F.col(score)), "_down", room, "_before", [key]).drop("_down")
    return rows.withColumn("take", F.greatest(F.lit(0.0), F.least(F.col(room), F.lit(float(budget)) - F.col("_before")))).drop("_before")
