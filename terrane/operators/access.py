"""Accessibility: gravity and cumulative opportunity over a long travel-time table, stations, congestion, rail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalar import gated_band
from terrane.operators.networks import origins, realigned
from terrane.operators.spatial import within as near_points
from terrane.params import Params


def opportunities(cells: DataFrame, zone: str, p: Params) -> DataFrame:
    """Jobs, retail, school and health opportunity of each zone; points of interest stand in where a measure is absent."""
    c = F.col
    retail = F.when((c("retail_poi") > 0) & (c("com_sqm") > 0), c("com_sqm")).otherwise(p.value("access.sqm_per_retail_poi") * c("retail_poi"))
    school = F.when(c("school_seats") > 0, c("school_seats")).otherwise(p.value("access.seats_per_education_poi") * c("education_poi"))
    health = F.when(c("beds") > 0, c("beds")).otherwise(p.value("access.beds_per_health_poi") * c("health_poi"))
    return cells.groupBy(zone).agg(F.sum("jobs").alias("o_work"), F.sum(retail).alias("o_retail"), F.sum(school).alias("o_education"), F.sum(health).alias("o_health"))


def destinations(cells: DataFrame, zone: str, jobs: str, min_jobs: float, limit: int) -> DataFrame:
    """The zones with most jobs, of those with min_jobs or more, or of all if none has, with mean coordinates; ties by zone."""
    by = cells.groupBy(zone).agg(F.sum(jobs).alias("jobs"), F.avg("x_m").alias("x_m"), F.avg("y_m").alias("y_m"))
    most = by.agg(F.coalesce(F.max("jobs"), F.lit(0.0)).alias("_most"))
    enough = (F.col("jobs") >= min_jobs) | (F.col("_most") < min_jobs)
    return by.join(F.broadcast(most)).filter(enough).drop("_most").orderBy(F.desc("jobs"), zone).limit(limit)


def od_pairs(cells: DataFrame, targets: DataFrame, origin: str, zone: str) -> DataFrame:
    """Every origin with every destination, and their distance: targets are those of destinations(), a capped set that
    is broadcast for that reason, with whatever columns they bring."""
    to = targets.withColumnsRenamed({"x_m": "_tx", "y_m": "_ty"})
    # origins are few bytes and pairs many: origins are dealt out by key first, and what is summed by origin stays there
    dealt = cells.select(origin, "x_m", "y_m").repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), origin)
    pairs = dealt.join(F.broadcast(to))
    return pairs.withColumn("dist_m", F.hypot(F.col("x_m") - F.col("_tx"), F.col("y_m") - F.col("_ty"))).drop("x_m", "y_m", "_tx", "_ty")


def minutes(metres: Column, kmh: float) -> Column:
    return metres / 1000 / kmh * 60


def gravity(pairs: DataFrame, origin: str, kmh: dict[str, float], shares: dict[str, float], betas: dict[str, dict[str, float]], weights: dict[str, float]) -> DataFrame:
    """ln(A + 1) of each purpose and their weighted sum: one aggregate over the pairs, whose minutes by mode come from
    dist_m and are infinite where that is null. Pairs of an origin lie in one task, so partial sums are all there is."""
    return _logs(pairs.groupBy(origin).agg(*_gravity_sums(kmh, shares, betas)), [origin], betas, weights)


def _gravity_sums(kmh: dict[str, float], shares: dict[str, float], betas: dict[str, dict[str, float]]) -> list[Column]:
    term = lambda purpose, mode: shares[mode] * F.exp(-betas[purpose][mode] * minutes(F.col("dist_m"), kmh[mode]))
    return [F.sum(F.coalesce(sum((term(x, m) for m in shares), F.lit(0.0)) * F.col(f"o_{x}"), F.lit(0.0))).alias(f"a_{x}") for x in betas]


def _logs(sums: DataFrame, keep: list[str], betas: dict[str, dict[str, float]], weights: dict[str, float]) -> DataFrame:
    logs = sums.select(*keep, *[F.log1p(f"a_{x}").alias(f"lna_{x}") for x in betas])
    return logs.withColumn("lna", sum((w * F.col(f"lna_{x}") for x, w in weights.items()), F.lit(0.0)))


def _reach_sums(kmh: dict[str, float], shares: dict[str, float], measure: str, limits: list[int]) -> list[Column]:
    within = lambda t: sum((F.when(minutes(F.col("dist_m"), kmh[m]) <= t, F.lit(float(s))).otherwise(0.0) for m, s in shares.items()), F.lit(0.0))
    return [F.sum(within(t) * F.col(measure)).alias(f"jobs_{t}") for t in limits]


def reachable(pairs: DataFrame, origin: str, kmh: dict[str, float], shares: dict[str, float], measure: str, limits: list[int]) -> DataFrame:
    """Opportunity within each limit of minutes, by mode share."""
    return pairs.groupBy(origin).agg(*_reach_sums(kmh, shares, measure, limits))


def layer(cells: DataFrame, key: str, zone: str, stations: DataFrame, kmh: dict[str, float], shares: dict[str, float], betas: dict[str, dict[str, float]], weights: dict[str, float], limits: list[int], p: Params) -> DataFrame:
    """(key, lna_<purpose>..., lna, jobs_<limit>..., station_weight) of all cells: the layer's results in one table.

    Origins are the cells of the city where people live or could (in_city, population, headroom_sqm); for others the
    gravity and the jobs are null, not 0. One aggregate over the pairs of origins and selected destinations gives both.
    stations (station, sx, sy, feeder); a cell without a station in reach has the weight 0.
    """
    targets = destinations(cells, zone, "jobs", p.value("access.min_destination_jobs"), p.value("access.max_destinations")).drop("jobs").join(opportunities(cells, zone, p), zone)
    pairs = od_pairs(origins(cells), targets, key, zone)
    sums = pairs.groupBy(key).agg(*_gravity_sums(kmh, shares, betas), *_reach_sums(kmh, shares, "o_work", limits))
    reach = [f"jobs_{t}" for t in limits]
    found = _logs(sums, [key, *reach], betas, weights)
    near = near_points(cells.select(key, "x_m", "y_m"), stations, float(max(b[0] for b in p.value("access.station_bands"))), "x_m", "y_m", "sx", "sy")
    served = station_weight(near, key, "dist_m", "feeder", p)
    out = realigned(found, cells, key).join(served, key, "left").withColumn("station_weight", F.coalesce("station_weight", F.lit(0.0)))
    return out.select(key, *[f"lna_{x}" for x in betas], "lna", *reach, "station_weight")


def station_weight(pairs: DataFrame, key: str, distance: str, feeder: str, p: Params) -> DataFrame:
    """The largest band weight over stations."""
    return pairs.groupBy(key).agg(F.max(gated_band(F.col(distance), p.value("access.station_bands"), F.col(feeder))).alias("station_weight"))


def congested(minutes: Column, origin: Column, destination: Column, middle: Column, p: Params) -> Column:
    slow = 1 - p.value("access.congestion.k") * (origin + destination + middle) / 3
    return minutes / F.greatest(F.lit(float(p.value("access.congestion.floor"))), slow)


def via_rail(access: DataFrame, rail: DataFrame, egress: DataFrame, penalty: float) -> DataFrame:
    """Least access + line haul + egress of each (origin, destination): two equi-joins and a min."""
    legs = access.join(rail, "board").join(egress, "alight")
    return legs.groupBy("origin", "destination").agg(F.min(F.col("walk_in") + F.col("haul") + F.col("walk_out") + penalty).alias("minutes"))
