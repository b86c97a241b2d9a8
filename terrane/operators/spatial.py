"""Joins by distance over projected points: a grid-bucket equi-join, then the exact distance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, radius: float, lx: str, ly: str, rx: str, ry: str, out: str = "dist_m") -> DataFrame:
    """Pairs no farther apart than radius. Right rows go to the nine squares around theirs, so no pair meets twice.

    The join is merged: Spark takes the nine copies for one row's bytes, and would broadcast far more than it thinks.
    """
    square = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("long")
    near = [F.lit(i) for i in (-1, 0, 1)]
    r = right.withColumn("_bx", F.explode(F.array(*[square(rx) + i for i in near]))).withColumn("_by", F.explode(F.array(*[square(ry) + i for i in near])))
    pairs = left.withColumn("_bx", square(lx)).withColumn("_by", square(ly)).join(r.hint("merge"), ["_bx", "_by"]).drop("_bx", "_by")
    return pairs.withColumn(out, F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry))).filter(F.col(out) <= radius)


def nearest(pairs: DataFrame, key: str, candidate: str, distance: str = "dist_m") -> DataFrame:
    """The nearest candidate of each key; the smallest candidate wins ties."""
    best = F.min(F.struct(F.col(distance), F.col(candidate)))
    return pairs.groupBy(key).agg(best.alias("b")).select(key, F.col(f"b.{candidate}").alias(candidate), F.col(f"b.{distance}").alias(distance))


def nearest_of(points: DataFrame, keys: list[str], sites: DataFrame, candidate: str, x: str, y: str, sx: str, sy: str, cut, start: float | None = None) -> DataFrame:
    """(keys..., candidate, dist_m): the site nearest to each point, however far; the smallest candidate wins ties.

    Points without a site within a radius are asked again with four times the radius, until it spans all. The first
    radius leaves a site or so to a square, if none is given. Sites at one place are one; points without a place, and all
    points where there is no site, have no row. cut writes a round, so that it is computed once.

    The points of a square share the sites that can be nearest in it, so far points do not meet all sites, and a point
    and its sites are one row, so nothing is grouped or sorted by pairs. Squares of many points are dealt out.
    """
    placed = lambda a, b: f"abs({a}) < double('Infinity') AND abs({b}) < double('Infinity')"
    own = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(placed("_x", "_y"))
    them = sites.select(F.col(candidate), F.col(sx).cast("double").alias("_sx"), F.col(sy).cast("double").alias("_sy")).filter(f"{placed('_sx', '_sy')} AND `{candidate}` IS NOT NULL")
    them = cut(them.groupBy("_sx", "_sy").agg(F.min(candidate).alias(candidate)))
    corners = [f(v).alias(f"{n}{v}") for v in ("_sx", "_sy") for n, f in (("low", F.min), ("high", F.max))]
    box = them.agg(F.count(F.lit(1)).alias("n"), *corners).first()
    none = own.limit(0).select(*keys, F.lit(None).cast(them.schema[candidate].dataType).alias(candidate), F.lit(0.0).alias("dist_m"))
    if not box["n"]:
        return none
    far = own.agg(*[f(v) for v in ("_x", "_y") for f in (F.min, F.max)]).first()
    if far[0] is None:
        return none
    sides = [max(far[2 * i + 1], box[2 * i + 2]) - min(far[2 * i], box[2 * i + 1]) for i in (0, 1)]
    span = math.hypot(*sides) + 1.0
    width, height = (max(1.0, box[2 * i + 2] - box[2 * i + 1]) for i in (0, 1))
    radius = min(float(start) if start else math.sqrt(width * height / box["n"]), span)
    out = None
    while True:
        asked = cut(_ask(own, keys, them, candidate, radius))
        found = asked.filter("dist_m IS NOT NULL").select(*keys, candidate, "dist_m")
        out = found if out is None else out.unionByName(found)
        own = asked.filter("dist_m IS NULL").select(*keys, "_x", "_y")
        if radius >= span or own.isEmpty():
            return out
        radius = min(4 * radius, span)


#: points of one square that one task takes
_HELD = 50_000


def _ask(own: DataFrame, keys: list[str], them: DataFrame, candidate: str, radius: float, held: int = _HELD) -> DataFrame:
    """own (keys, _x, _y) with the nearest site, if it is within radius, and dist_m; both are null where none is."""
    square = lambda v: F.floor(F.col(v) / F.lit(float(radius))).cast("long")
    at, apart = ["_bx", "_by"], lambda x, y, u, v: (x - u) * (x - u) + (y - v) * (y - v)
    c = F.col
    rows = own.withColumn("_bx", square("_x")).withColumn("_by", square("_y"))
    ends = [f(v).alias(f"{v}{i}") for v in ("_x", "_y") for i, f in enumerate((F.min, F.max))]
    boxes = rows.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / held).alias("_parts"), *ends)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = them.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).select(candidate, "_sx", "_sy", (square("_sx") + c("_i")).alias("_bx"), (square("_sy") + c("_j")).alias("_by"))
    pairs = boxes.join(spread.hint("merge"), at).withColumn("_mid", apart((c("_x0") + c("_x1")) / 2, (c("_y0") + c("_y1")) / 2, c("_sx"), c("_sy")))
    first = pairs.groupBy(*at).agg(F.min_by("_sx", "_mid").alias("_px"), F.min_by("_sy", "_mid").alias("_py"))
    # a square of a distance less another is linear in the point: who is farther at all four corners is so in the box,
    # and by more than rounding can hide
    edges = [(c(i), c(j)) for i in ("_x0", "_x1") for j in ("_y0", "_y1")]
    theirs = [apart(i, j, c("_sx"), c("_sy")) for i, j in edges]
    least = F.least(*[d - apart(i, j, c("_px"), c("_py")) for d, (i, j) in zip(theirs, edges, strict=True)])
    able = pairs.join(first.hint("merge"), at).filter(least <= 1e-9 * F.greatest(*theirs))
    lists = able.groupBy(*at).agg(F.first("_parts").alias("_parts"), F.collect_list(F.struct("_sx", "_sy", candidate)).alias("_near"))
    lists = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), c("_parts") - 1))).drop("_parts")
    # there is one such square to so many points at most
    many = F.broadcast(boxes.filter("_parts > 1").select(*at, "_parts"))
    dealt = rows.join(many, at, "left").withColumn("_part", F.pmod(F.xxhash64(*keys), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    best = F.array_min(F.transform("_near", lambda s: F.struct(F.sqrt(apart(c("_x"), c("_y"), s["_sx"], s["_sy"])).alias("d"), s[candidate].alias("s"))))
    got = dealt.join(lists.hint("merge"), [*at, "_part"], "left").withColumn("_b", best)
    inside = F.when(c("_b.d") <= radius, c("_b"))
    return got.select(*keys, "_x", "_y", inside["s"].alias(candidate), inside["d"].alias("dist_m"))


def knn(points: DataFrame, key: str, other: str, k: int, x: str, y: str, start: float, cut) -> DataFrame:
    """(key, other, dist_m) of the k nearest others of each point, ties by id, however far: points that have fewer than
    k within a radius are asked again with twice the radius, until it spans all. cut writes a round."""
    own = points.select(key, F.col(x).alias("_x"), F.col(y).alias("_y"))
    them = points.select(F.col(key).alias(other), F.col(x).alias("_ox"), F.col(y).alias("_oy"))
    box = own.agg(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")).first()
    span = max(start, ((box[0] or 0.0) ** 2 + (box[1] or 0.0) ** 2) ** 0.5)
    radius, out = float(start), None
    while True:
        pairs = within(own, them, radius, "_x", "_y", "_ox", "_oy").filter(F.col(key) != F.col(other))
        rank = F.row_number().over(Window.partitionBy(key).orderBy("dist_m", other))
        near = pairs.select(key, other, "dist_m", rank.alias("_r")).filter(F.col("_r") <= k)
        counted = cut(near.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))))
        done = counted.filter(F.col("_n") == k) if radius < span else counted
        part = done.select(key, other, "dist_m")
        out = part if out is None else out.unionByName(part)
        if radius >= span:
            return out
        own = own.join(done.select(key).distinct(), key, "left_anti")
        if own.isEmpty():
            return out
        own = cut(own)
        radius = min(2 * radius, span)


def knn_weights(pairs: DataFrame, key: str, other: str, k: int, distance: str = "dist_m") -> DataFrame:
    """Row-standardised weights of the k nearest others; ties by id."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(distance, other))
    rows = pairs.filter(F.col(key) != F.col(other)).withColumn("_r", rank).filter(F.col("_r") <= k)
    return rows.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(key))).drop("_r")


def gaussian_smear(pairs: DataFrame, key: str, value: str, sigma: float, distance: str = "dist_m") -> DataFrame:
    """Kernel-weighted mean of the values around each key."""
    w = F.exp(-F.col(distance) ** 2 / (2 * sigma * sigma))
    return pairs.groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("smeared"), F.count(F.lit(1)).alias("n_points"))


def morans_i(weights: DataFrame, key: str, other: str, values: DataFrame, value: str) -> DataFrame:
    """One row: Moran's I over the weights (n / S0 * sum u Wu / sum u u)."""
    mean = values.agg(F.avg(value).alias("_mean"))
    u = values.join(F.broadcast(mean)).select(F.col(key).alias("_k"), (F.col(value) - F.col("_mean")).alias("_u"))
    # merged: files of few bytes may hold many rows
    pairs = weights.join(u.withColumnRenamed("_k", key).hint("merge"), key).join(u.select(F.col("_k").alias(other), F.col("_u").alias("_v")).hint("merge"), other)
    top = pairs.agg(F.sum(F.col("weight") * F.col("_u") * F.col("_v")).alias("_top"), F.sum("weight").alias("_s0"))
    bottom = u.agg(F.sum(F.col("_u") * F.col("_u")).alias("_uu"), F.count(F.lit(1)).alias("_n"))
    return top.join(F.broadcast(bottom)).select((F.col("_n") / F.col("_s0") * F.col("_top") / F.col("_uu")).alias("moran_i"))
