"""Site monitoring as streams: windowed composites with a watermark, and a ratchet that holds state by site."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrane.sources.ship import ship_package

RATCHET_OUT = "project long, event_id long, ratcheted long"


def composite_stream(events: DataFrame, window: str = "7 days", late: str = "2 days") -> DataFrame:
    """Mean and count of clear observations of each project and window; events later than the watermark are dropped."""
    clear = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).filter("clear")
    out = clear.groupBy(F.window("ts", window), "project").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return out.select("project", F.col("window.start").alias("start"), "value", "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(project, start, end, n, value, top): runs of a project's events no more than a gap apart; end is a gap after the
    last. The same for a table and for a stream, which needs late: a run is given once no event can join it any more.

    Spark keeps the runs as state and merges them in native code. Events without a time belong to no run.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    runs = timed.groupBy("project", F.session_window("ts", gap).alias("w"))
    out = runs.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.max("state_rank").alias("top"))
    return out.select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value", "top")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    top = state.get[0] if state.exists else -1
    for rows in batches:
        rows = rows[rows["state_rank"].notna()].sort_values(["ts", "event_id"])
        if len(rows):
            high = rows["state_rank"].cummax().clip(lower=top).astype("int64")
            top = int(high.iloc[-1])
            yield pd.DataFrame({"project": key[0], "event_id": rows["event_id"], "ratcheted": high})
    state.update((top,))


def ratchet_stream(events: DataFrame) -> DataFrame:
    """Highest state so far of each project, over batches: only the highest rank is kept as state."""
    ship_package(events.sparkSession)
    return events.groupBy("project").applyInPandasWithState(_advance, RATCHET_OUT, "top long", "append", GroupStateTimeout.NoTimeout)
