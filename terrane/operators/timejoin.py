"""As-of and interval joins cut at common points in time, so that a key of very many rows runs over many tasks.

Both sides are cut by the same few hundred points, quantiles of all their times; rows meet by key and slice. What a
slice starts with is carried over the cut: the last row of the slices before it, of which a key has as many as there
are slices at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256


def _ticks(df: DataFrame, at: str) -> Column:
    """Seconds, with their fraction, of a timestamp; a number as it is."""
    return F.unix_micros(F.col(at).cast("timestamp")) / 1e6 if dict(df.dtypes)[at].startswith("timestamp") else F.col(at).cast("double")


def cut_points(frames: list[tuple[DataFrame, str]], slices: int = SLICES) -> list[float]:
    """Up to slices - 1 points that cut the times of all frames into about equal parts; fewer where times repeat."""
    times = None
    for df, at in frames:
        rows = df.select(F.col(at).alias("t"))
        times = rows if times is None else times.unionByName(rows)
    shares = [i / slices for i in range(1, slices)]
    got = times.agg(F.percentile_approx("t", F.array(*map(F.lit, shares)), 10 * slices)).first()[0]
    return sorted(set(got or []))


def _slice(at: Column, points: list[float]) -> Column:
    """The number of points at or below a time."""
    return F.size(F.filter(F.array(*[F.lit(float(p)) for p in points]), lambda p: p <= at)) if points else F.lit(0)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, order: str, values: list[str], slices: int = SLICES) -> DataFrame:
    """left with values, those of the last row of right with its key at or before its time; null where there is none.

    Times are timestamps or numbers. Of right's rows at one time the one with the greatest order counts. Left rows
    without a key or a time keep nulls; right rows without either are left out. Both tables may have rows of any number
    for a key, and rows that repeat.
    """
    a = left.withColumn("_t", _ticks(left, time))
    b = right.select(F.col(key).alias("_k"), _ticks(right, right_time).alias("_t"), F.struct(F.col(order).alias("_o"), *values).alias("_v")).filter("_k IS NOT NULL AND _t IS NOT NULL")
    points = cut_points([(a, "_t"), (b, "_t")], slices)
    a, b = a.withColumn("_s", _slice(F.col("_t"), points)), b.withColumn("_s", _slice(F.col("_t"), points))
    known = a.filter(F.col(key).isNotNull() & F.col("_t").isNotNull())
    last = b.groupBy("_k", "_s").agg(F.max(F.struct("_t", "_v")).alias("_last"))
    # each slice that has left rows starts with the last row of the slices before it
    seen = known.select(F.col(key).alias("_k"), "_s").distinct().join(last, ["_k", "_s"], "full")
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.select("_k", "_s", F.last("_last._v", True).over(before).alias("_carry"))
    rows = known.withColumn("_id", F.struct(*left.columns)).select(F.col(key).alias("_k"), "_s", "_t", F.lit(1).alias("_side"), F.lit(None).cast(b.schema["_v"].dataType).alias("_v"), "_id")
    both = rows.unionByName(b.select("_k", "_s", "_t", F.lit(0).alias("_side"), "_v", F.lit(None).cast(rows.schema["_id"].dataType).alias("_id")))
    within = Window.partitionBy("_k", "_s").orderBy("_t", "_side", F.col("_v._o").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_v", True).over(within)).filter("_side = 1").select("_k", "_s", "_id", "_found")
    out = found.join(carried, ["_k", "_s"], "left").select("_id.*", F.coalesce("_found", "_carry").alias("_got")).select(*left.columns, *[F.col(f"_got.{v}").alias(v) for v in values])
    lost = a.filter(F.col(key).isNull() | F.col("_t").isNull()).select(*left.columns, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    return out.unionByName(lost)


def in_intervals(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, values: list[str], slices: int = SLICES) -> DataFrame:
    """points with values of each interval of its key that holds its time: start <= time < end.

    An interval goes to each slice that it meets; a point is in one. Intervals without a bound, and empty ones, hold
    nothing. A pair that a key and a time join is in the result once, as often as its rows repeat.
    """
    a = points.withColumn("_t", _ticks(points, time))
    b = intervals.select(F.col(key).alias("_k"), _ticks(intervals, start).alias("_from"), _ticks(intervals, end).alias("_to"), *[F.col(v).alias(f"_{v}") for v in values]).filter("_from < _to")
    cuts = cut_points([(a, "_t"), (b, "_from"), (b, "_to")], slices)
    b = b.withColumn("_s", F.explode(F.sequence(_slice(F.col("_from"), cuts), _slice(F.col("_to"), cuts))))
    a = a.withColumn("_s", _slice(F.col("_t"), cuts))
    pairs = a.join(b, (F.col(key) == F.col("_k")) & (a["_s"] == b["_s"]) & (F.col("_from") <= F.col("_t")) & (F.col("_t") < F.col("_to")))
    return pairs.select(*points.columns, *[F.col(f"_{v}").alias(v) for v in values])
