"""Backtests that cannot look ahead: a frozen state at t0, baselines, a score card, intervals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.scalar import step_up
from terrane.operators import market, measures as ms
from terrane.operators.govern import GuardError, no_lookahead, vintage_ok
from terrane.operators.spatial import within


@dataclass(frozen=True)
class Frozen:
    """What was known at the end of year t0."""

    t0: int
    cells: DataFrame
    history: DataFrame
    projects: DataFrame


def freeze(t0: int, cells: DataFrame, history: DataFrame, projects: DataFrame, stages: DataFrame, vintages: dict[str, int | None], max_age: int = 5, outcomes: DataFrame | None = None, min_dead: int = 0) -> Frozen:
    """cells (cell, price, ...), history (cell, year, price), projects (project_id, announced_year, ...), stages
    (project_id, year, stage).

    History and projects after t0 go; each project's stage is its last one by t0, and a project without any raises;
    a cell's price at t0 is history's, else the present one. Enough of the projects must have been abandoned since.
    """
    vintage_ok(vintages, t0, max_age)
    past = no_lookahead(history.filter(F.col("year") <= t0), t0, "year")
    known = projects.filter(F.col("announced_year") <= t0)
    rolled = ms.latest_as_of(stages, ["project_id"], "year", F.lit(t0), ["stage"]).select("project_id", "stage")
    out = known.drop("stage").join(rolled, "project_id", "left")
    lost = out.filter("stage IS NULL").count()
    if lost:
        raise GuardError(f"{lost} projects have no stage by {t0}")
    if outcomes is not None and min_dead:
        dead = known.join(outcomes.filter("outcome = 'abandoned'"), "project_id", "left_semi").count()
        if dead < min_dead:
            raise GuardError(f"{dead} abandoned projects; {min_dead} are needed")
    then = past.filter(F.col("year") == t0).select("cell", F.col("price").alias("_then"))
    state = cells.join(then, "cell", "left").withColumn("price", F.coalesce("_then", "price")).drop("_then")
    return Frozen(t0, state, past, out)


def b0_city(frozen: Frozen, years: int, lookback: int) -> DataFrame:
    """Every cell grows as the city did."""
    rate = ms.cagr(frozen.history.withColumn("all", F.lit(1)), "all", "year", "price", frozen.t0 - lookback, frozen.t0, -0.2, 0.5).select("cagr")
    return frozen.cells.join(F.broadcast(rate)).select("cell", (F.col("price") * F.pow(1 + F.col("cagr"), F.lit(float(years)))).alias("pred"))


def b1_distance(frozen: Frozen, distance: str, low: float = -1.0, high: float = 0.0) -> DataFrame:
    """log price on log distance, slope clipped, level such that the mean stays."""
    rows = frozen.cells.filter("price > 0").withColumn("_y", F.ln("price")).withColumn("_x", F.ln(1 + F.col(distance)))
    fit = rows.agg(F.greatest(F.lit(low), F.least(F.lit(high), F.regr_slope("_y", "_x"))).alias("_b"), F.avg("_y").alias("_my"), F.avg("_x").alias("_mx"))
    return frozen.cells.join(F.broadcast(fit)).select("cell", F.exp(F.col("_my") + F.col("_b") * (F.ln(1 + F.col(distance)) - F.col("_mx"))).alias("pred"))


def b2_momentum(frozen: Frozen, years: int, lookback: int) -> DataFrame:
    """Every cell grows as it did; as the city where it has no history."""
    rate = ms.cagr(frozen.history, "cell", "year", "price", frozen.t0 - lookback, frozen.t0, -0.2, 0.5)
    return frozen.cells.join(rate, "cell", "left").select("cell", (F.col("price") * F.pow(1 + F.coalesce("cagr", F.lit(0.0)), F.lit(float(years)))).alias("pred"))


def b4_growth(train: DataFrame, now: DataFrame, features: list[str], label: str, room: str, budget: float, steps: int, cut, c: float = 1.0) -> DataFrame:
    """Logistic growth: chances by ridge-penalised logistic regression, then the budget filled from the likeliest cell."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=features, outputCol="_f")
    rows = vectors.transform(train)
    model = LogisticRegression(featuresCol="_f", labelCol=label, regParam=1.0 / (c * max(rows.count(), 1)), standardization=False, probabilityCol="_p").fit(rows)
    state = now.withColumn("built", F.lit(0.0))
    for _ in range(steps):
        scored = model.transform(vectors.transform(state)).withColumn("chance", vector_to_array("_p")[1]).select(*state.columns, "chance")
        taken = market.greedy_fill(scored, "chance", "cell", room, budget)
        state = cut(taken.withColumn("built", F.col("built") + F.col("take")).withColumn(room, F.col(room) - F.col("take")).select(*state.columns))
    return state


def score(rows: DataFrame, pred: str, actual: str, start: str, years: int, k: int = 50, low: str | None = None, high: str | None = None) -> DataFrame:
    """One row: rank correlation, precision at k, error of growth, and coverage where there is a band."""
    g = lambda col: F.when((F.col(start) > 0) & (F.col(col) > 0), F.pow(F.col(col) / F.when(F.col(start) > 0, F.col(start)), F.lit(1.0 / years)) - 1)
    grown = rows.withColumn("_gp", g(pred)).withColumn("_ga", g(actual)).filter("_gp IS NOT NULL AND _ga IS NOT NULL")
    out = ms.spearman(grown, "_gp", "_ga").join(F.broadcast(ms.top_k_precision(grown, "cell", "_gp", "_ga", k, 0.9).select("precision"))).join(F.broadcast(ms.mape(grown, "_gp", "_ga", 0.005).select("mape")))
    return out.join(F.broadcast(ms.band_coverage(rows, actual, low, high).select("coverage"))) if low and high else out


#: Modulus of the resampling's arithmetic, which any engine can repeat.
PRIME = 2147483647


def resampled(seed: int, draws: int, n: int) -> np.ndarray:
    """Indices of draws samples of n with replacement, from whole-number arithmetic on seed, sample and place alone."""
    i, j = np.arange(draws, dtype=np.int64)[:, None], np.arange(n, dtype=np.int64)[None, :]
    x = (seed % PRIME + i * 69621 + j * 48271) % PRIME
    x = (x * x + 12345 + i) % PRIME
    x = (x * 16807 + j) % PRIME
    return (x * x + 67891) % PRIME % n


def bootstrap_ci(values: list[float], seed: int, draws: int = 2000, level: float = 0.9) -> tuple[float, float, float]:
    """(low, median, high) of the median over a handful of cities."""
    x = np.asarray(values, float)
    if not len(x):
        raise ValueError("no values")
    medians = np.median(x[resampled(seed, draws, len(x))], axis=1)
    low, high = np.quantile(medians, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(np.median(x)), float(high)


def bootstrap_rank_difference(rows: DataFrame, pred: str, reference: str, actual: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, difference) of rank correlations over zones drawn with replacement, as many as there are.

    Draw j of a replicate is the zone of the number that whole-number arithmetic on (seed, replicate, j) gives, so a
    rerun and a different partitioning agree; zones are numbered in their order. One plan for all replicates; rows are
    never collected. A zone's rows are drawn together.
    """
    named = rows.select("zone").distinct().select("zone", F.row_number().over(Window.orderBy("zone")).cast("long").alias("_z"))
    n = named.count()
    zones = rows.select("zone", pred, reference, actual).join(named, "zone").drop("zone")
    i, j, p = F.col("replicate"), F.col("_j"), F.lit(PRIME).cast("long")
    x = (F.lit(seed % PRIME).cast("long") + i * 69621 + j * 48271) % p
    steps = rows.sparkSession.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.expr(f"sequence(0L, {max(n - 1, 0)}L)")).alias("_j")).withColumn("_x", x)
    steps = steps.withColumn("_x", (F.col("_x") * F.col("_x") + 12345 + i) % p).withColumn("_x", (F.col("_x") * 16807 + j) % p)
    drawn = steps.select("replicate", ((F.col("_x") * F.col("_x") + 67891) % p % max(n, 1) + 1).alias("_z"))
    out = drawn.groupBy("replicate", "_z").agg(F.count(F.lit(1)).alias("_n")).join(zones, "_z").drop("_z")
    for c in (pred, reference, actual):
        counts = out.groupBy("replicate", c).agg(F.sum("_n").alias("_m"))
        before = F.expr("sum(_m) OVER (PARTITION BY replicate ORDER BY `%s` ROWS UNBOUNDED PRECEDING)" % c)
        out = out.join(counts.select("replicate", c, (before - F.col("_m") + (F.col("_m") + 1) / 2).alias(f"_r_{c}")), ["replicate", c])

    def corr(a: str, b: str) -> F.Column:
        w, x, y = F.col("_n"), F.col(f"_r_{a}"), F.col(f"_r_{b}")
        n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
        top = F.sum(w * x * y) - sx * sy / n
        return top / F.sqrt((F.sum(w * x * x) - sx * sx / n) * (F.sum(w * y * y) - sy * sy / n))

    return out.groupBy("replicate").agg((corr(pred, actual) - corr(reference, actual)).alias("difference"))


def announcement_premium(cells: DataFrame, sites: DataFrame, bands: list, beyond: float, reach: float) -> DataFrame:
    """(cell, premium): what a naive buyer adds for announcements, the sum of ln(1 + share) over sites (sx, sy) within
    reach, by the band of (limit, share) that the distance is in, or beyond. Cells without a site in reach have no row."""
    near = within(cells.select("cell", "x_m", "y_m"), sites, reach, "x_m", "y_m", "sx", "sy")
    return near.groupBy("cell").agg(F.sum(F.ln(1 + step_up(F.col("dist_m"), bands, F.lit(float(beyond))))).alias("premium"))
