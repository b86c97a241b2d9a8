"""Score cards of backtests and the gate that a release must pass: one row a city and origin, one row a criterion."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import measures as ms
from terrane.params import Params
from terrane.plans.backtest import bootstrap_ci, bootstrap_rank_difference

c = F.col
#: One row a card; metrics are null where they could not be measured.
CARD = (
    "city string, t0 long, horizon long, n_zones long, spearman double, top_precision double, beat_b2 double, beat_b2_low double, beat_b2_high double, coverage double, overheat_precision double, "
    "mape double, settlement_spearman double, beat_b4 double, price_test boolean, alarm boolean, underpowered boolean"
)


def reliability(rows: DataFrame, actual: str, pairs: list[tuple[float, str, str]]) -> DataFrame:
    """(nominal, observed): the share of actual values in each symmetric band, over rows with both ends; one aggregate."""
    there = lambda low, high: c(actual).isNotNull() & c(low).isNotNull() & c(high).isNotNull()
    got = rows.agg(*[F.avg(F.when(there(low, high), c(actual).between(c(low), c(high)).cast("double"))).alias(f"_{i}") for i, (_, low, high) in enumerate(pairs)])
    points = F.explode(F.array(*[F.struct(F.lit(float(n)).alias("nominal"), c(f"_{i}").alias("observed")) for i, (n, _, _) in enumerate(pairs)]))
    return got.select(points.alias("p")).select("p.nominal", "p.observed")


def overheat_precision(rows: DataFrame, flagged: Column, actual: str, q: float = 0.5) -> DataFrame:
    """One row: share of flagged zones that then grew less than a quantile of all."""
    cut = ms.quantiles(rows, {"_cut": (actual, q)})
    return rows.join(F.broadcast(cut)).filter(flagged & c(actual).isNotNull()).agg(F.avg((c(actual) < c("_cut")).cast("double")).alias("overheat_precision"))


def card(zones: DataFrame, city: str, t0: int, horizon: int, p: Params, k: int = 3, replicates: int = 2000, price_test: bool = True) -> DataFrame:
    """One row of CARD from zones (zone, pred, b2, actual, and where known low, high, overheated, settled, settled_pred,
    settled_b4), growth rates of each zone.

    Without the price test only settlement is scored. An alarm is a rank correlation too good to be true.
    """
    have = set(zones.columns)
    one = zones.agg(F.count(F.lit(1)).alias("n_zones"))
    null = lambda name: F.lit(None).cast("double").alias(name)

    def add(frame: DataFrame, part: DataFrame) -> DataFrame:
        return frame.join(F.broadcast(part))  # one row each

    if price_test:
        both = zones.filter("pred IS NOT NULL AND actual IS NOT NULL")
        one = add(one, ms.spearman(both, "pred", "actual").select(c("rho").alias("spearman")))
        one = add(one, ms.spearman(both.filter("b2 IS NOT NULL"), "b2", "actual").select(c("rho").alias("_b2")))
        one = add(one, ms.top_k_precision(both, "zone", "pred", "actual", k, 0.9).select(c("precision").alias("top_precision")))
        one = add(one, ms.mape(both, "pred", "actual", 0.001).select("mape"))
        differences = bootstrap_rank_difference(both.filter("b2 IS NOT NULL"), "pred", "b2", "actual", replicates, int(p.value("gate.seed")))
        one = add(one, differences.agg(F.percentile("difference", F.lit(0.05)).alias("beat_b2_low"), F.percentile("difference", F.lit(0.95)).alias("beat_b2_high")))
        one = add(one, ms.band_coverage(zones.filter("actual IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL"), "actual", "low", "high").select("coverage")) if {"low", "high"} <= have else one.select("*", null("coverage"))
        one = add(one, overheat_precision(both, c("overheated"), "actual")) if "overheated" in have else one.select("*", null("overheat_precision"))
    else:
        one = one.select("*", *[null(x) for x in ("spearman", "_b2", "top_precision", "mape", "beat_b2_low", "beat_b2_high", "coverage", "overheat_precision")])
    if {"settled", "settled_pred"} <= have:
        one = add(one, ms.spearman(zones, "settled_pred", "settled").select(c("rho").alias("settlement_spearman")))
    else:
        one = one.select("*", null("settlement_spearman"))
    one = add(one, ms.spearman(zones, "settled_b4", "settled").select(c("rho").alias("_b4"))) if {"settled", "settled_b4"} <= have else one.select("*", null("_b4"))
    out = one.select(
        F.lit(city).alias("city"), F.lit(t0).cast("long").alias("t0"), F.lit(horizon).cast("long").alias("horizon"), "n_zones", "spearman", "top_precision", (c("spearman") - c("_b2")).alias("beat_b2"), "beat_b2_low", "beat_b2_high", "coverage",
        "overheat_precision", "mape", "settlement_spearman", (c("settlement_spearman") - c("_b4")).alias("beat_b4"), F.lit(price_test).alias("price_test"),
        F.coalesce(c("spearman") > p.value("gate.alarm"), F.lit(False)).alias("alarm"), (c("n_zones") < p.value("gate.min_zones")).alias("underpowered"),
    )
    return out


def to_json(cards: DataFrame) -> list[str]:
    """A line of JSON for each card, which from_json reads back."""
    return [json.dumps(r.asDict(), sort_keys=True) for r in cards.collect()]  # one row a backtest


def from_json(spark: SparkSession, lines: list[str]) -> DataFrame:
    names = [x.split()[0] for x in CARD.split(", ")]
    return spark.createDataFrame([tuple(json.loads(x).get(n) for n in names) for x in lines], CARD)


def gate(cards: DataFrame, p: Params) -> DataFrame:
    """(criterion, observed, passed): six criteria over the cards, and a seventh where the parameter asks for it.

    Enough cities; every card with enough zones; the median rank correlation, and the median lead over momentum, above
    their bounds; the lower end of the bootstrap interval of that median over cities above its own, undefined with
    fewer than two cities, which fails; and the median coverage between its bounds. Cards without the price test count
    in the first two alone. A median without values fails.
    """
    spark = cards.sparkSession
    priced = c("price_test")
    leads = [float(r[0]) for r in cards.filter(priced & c("beat_b2").isNotNull()).select("beat_b2").orderBy("city", "t0").collect()]  # one number a backtest
    low = bootstrap_ci(leads, int(p.value("gate.seed")))[0] if len(leads) > 1 else None
    ci = spark.createDataFrame([(low,)], "_low double")
    least = lambda path: float(p.value(path))
    one = cards.agg(
        F.countDistinct("city").alias("_cities"), F.count_if(~(c("underpowered") | (c("n_zones") < p.value("gate.min_zones")))).alias("_powered"), F.count(F.lit(1)).alias("_cards"),
        F.median(F.when(priced, c("spearman"))).alias("_rho"), F.median(F.when(priced, c("beat_b2"))).alias("_beat"), F.median(F.when(priced, c("coverage"))).alias("_cover"), F.median("beat_b4").alias("_b4"),
    ).join(F.broadcast(ci))
    tests = [
        ("cities", c("_cities").cast("double"), c("_cities") >= p.value("gate.min_cities")), ("powered", c("_powered").cast("double"), c("_powered") == c("_cards")),
        ("median_spearman", c("_rho"), c("_rho") > least("gate.min_median_spearman")), ("median_beat_b2", c("_beat"), c("_beat") > least("gate.min_median_beat")),
        ("beat_b2_ci_lower", c("_low"), c("_low") > least("gate.min_beat_ci_lower")),
        ("median_coverage", c("_cover"), c("_cover").between(least("gate.min_median_coverage"), least("gate.max_median_coverage"))),
    ]
    if p.value("gate.gate_on_b4"):
        tests.append(("median_beat_b4", c("_b4"), c("_b4") > least("gate.min_median_beat")))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("criterion"), v.alias("observed"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, v, ok in tests]))
    return one.select(rows.alias("t")).select("t.criterion", "t.observed", "t.passed")


def verdict(cards: DataFrame, p: Params) -> tuple[bool, list[str]]:
    """Whether every criterion passed, and warnings: cards without the price test, alarms of look-ahead, a loss to B4."""
    tests = gate(cards, p).collect()
    warnings = []
    got = cards.agg(F.count_if(~c("price_test")).alias("settled"), F.median("beat_b4").alias("b4")).first()
    if got["settled"]:
        warnings.append(f"{got['settled']} cards scored settlement only")
    alarmed = [f"{r.city}@{r.t0}" for r in cards.filter("alarm").select("city", "t0").orderBy("city", "t0").collect()]
    if alarmed:
        warnings.append(f"rank correlations that suggest look-ahead: {', '.join(alarmed)}")
    if not p.value("gate.gate_on_b4") and got["b4"] is not None and got["b4"] <= 0:
        warnings.append("the growth baseline predicts settlement better")
    return all(r.passed for r in tests), warnings
