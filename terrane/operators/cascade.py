"""Supplier cascades: projects that an anchor draws after it, generation by generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.spatial import within
from terrane.params import ParamError

TIERS = "archetype string, tier long, jobs_ratio double, p_mult double, lag_years double, radius_m double, follows string"


def candidates(cells: DataFrame, freight: float | None = None) -> DataFrame:
    """Zoned and powered cells; where cells say how well freight reaches them, those above a threshold, which must be given."""
    out = cells.filter("zoned AND powered")
    if "freight_access" not in cells.columns:
        return out
    if freight is None:
        raise ParamError("cells have freight_access, so a threshold is needed")
    return out.filter(F.col("freight_access") > freight)


def inject(anchors: DataFrame, tiers: DataFrame, cells: DataFrame, radius: float, freight: float | None = None) -> DataFrame:
    """Jobs of each (anchor, tier) shared among candidate cells by logit, within the tier's radius.

    anchors: id, archetype, x, y, jobs, p, open_year. Start is the opening year plus the lag, rounded half to even.
    """
    entries = anchors.join(F.broadcast(tiers), "archetype").withColumnRenamed("jobs", "anchor_jobs")
    near = within(candidates(cells, freight), entries, radius, "x_m", "y_m", "x", "y").filter(F.col("dist_m") <= F.col("radius_m"))
    w = Window.partitionBy("id", "tier")
    e = F.exp(F.col("score") - F.max("score").over(w))
    out = near.withColumn("_e", e)
    share = F.col("_e") / F.sum("_e").over(w)
    return out.select(
        "id", "tier", "cell", F.col("follows").alias("archetype"), F.col("x_m").alias("x"), F.col("y_m").alias("y"), (F.col("anchor_jobs") * F.col("jobs_ratio") * share).alias("jobs"),
        (F.col("p") * F.col("p_mult")).alias("p"), F.rint(F.col("open_year") + F.col("lag_years")).alias("open_year"),
    )


def resolve(anchors: DataFrame, tiers: DataFrame, cells: DataFrame, radius: float, generations: int, cut, freight: float | None = None) -> DataFrame:
    """All generations in one frame; each is written by cut before the next is drawn from it."""
    out, now = None, anchors
    for generation in range(1, generations + 1):
        made = cut(inject(now, tiers, cells, radius, freight).withColumn("generation", F.lit(generation)))
        if made.isEmpty():
            break
        out = made if out is None else out.unionByName(made)
        now = made.groupBy("id", "tier", "archetype").agg(
            F.sum("jobs").alias("jobs"), F.avg("p").alias("p"), F.max("open_year").alias("open_year"), F.avg("x").alias("x"), F.avg("y").alias("y")
        ).select(F.concat_ws("/", "id", "tier").alias("id"), "archetype", "jobs", "p", "open_year", "x", "y")
    return out if out is not None else cut(inject(anchors, tiers, cells, radius, freight).withColumn("generation", F.lit(0)).filter("false"))
