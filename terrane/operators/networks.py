"""Network states over years, the rail graph, and travel-time tables that are made once and read by state and mode."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators.spatial import nearest_of, within
from terrane.params import Params
from terrane.sources.ship import kept, ship_package

c = F.col
OD = "state string, mode string, origin string, destination string, minutes double"


#: Ids joined into one piece of a year's list.
PIECE = 4096


class NetworkError(ValueError):
    """More network states than may be computed."""


def state_hash(ids: list[str]) -> str:
    """Name of a set of open projects: SHA-256 of their sorted ids as a JSON list without blanks."""
    return hashlib.sha256(json.dumps(sorted(ids), separators=(",", ":")).encode()).hexdigest()


def _opened(projects: DataFrame, project: str, open_year: str) -> DataFrame:
    """(_id, _from): each project and the first year in which it is open."""
    return projects.filter(c(open_year).isNotNull()).groupBy(c(project).cast("string").alias("_id")).agg(F.min(F.ceil(c(open_year)).cast("long")).alias("_from"))


def _distinct_states(opened: DataFrame, years: DataFrame) -> int:
    """How many states the years have: sets only grow, so two years share one if as many projects are open."""
    by = opened.groupBy("_from").agg(F.count(F.lit(1)).alias("_n"))
    return years.select("year").distinct().join(F.broadcast(by), c("_from") <= c("year"), "left").groupBy("year").agg(F.sum("_n").alias("_n")).select("_n").distinct().count()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's pieces, by year and place, into a hash for each year; a piece at a time is held."""
    at, digest, n, out = None, None, 0, []

    def done() -> None:
        if at is not None:
            digest.update(b"]")
            out.append((at, n, digest.hexdigest()))

    for batch in batches:
        for year, size, ids in zip(*(batch.column(i) for i in range(3))):
            if year.as_py() != at:
                done()
                at, digest, n = year.as_py(), hashlib.sha256(b"["), 0
            elif n:
                digest.update(b",")
            digest.update(ids.as_py().encode())
            n += size.as_py()
    done()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["year", "n_open", "state"])


def states_by_year(projects: DataFrame, years: DataFrame, project: str, open_year: str) -> DataFrame:
    """(year, n_open, state): how many projects are open and the name of which, as state_hash gives it.

    Ids are sorted once, in ranges, and joined into pieces of PIECE ids in many tasks. A SHA-256 is sequential, so the
    pieces of one year pass through one task, one after the other; no row holds a year's list. Years are few.
    """
    return _named(_opened(projects, project, open_year), years)


def _named(opened: DataFrame, years: DataFrame) -> DataFrame:
    years = years.select("year").distinct()
    parts = int(opened.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a range of ids is one task; ids within it are numbered, and PIECE of them go to one piece
    ranged = kept(opened.repartitionByRange(parts, "_id").sortWithinPartitions("_id").withColumn("_p", F.spark_partition_id()), "open")
    each = ranged.join(F.broadcast(years), c("_from") <= c("year"))
    place = F.row_number().over(Window.partitionBy("_p", "year").orderBy("_id"))
    quoted = F.expr("substring(to_json(array(_id)), 2, length(to_json(array(_id))) - 2)")
    rows = each.select("year", "_p", "_id", F.floor((place - 1) / PIECE).alias("_k"), quoted.alias("_q"))
    pieces = rows.groupBy("year", "_p", "_k").agg(F.count(F.lit(1)).alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", "_q"))), lambda s: s["_q"]), ",").alias("_ids"))
    ship_package(opened.sparkSession)
    dealt = pieces.repartition(parts, "year").sortWithinPartitions("year", "_p", "_k").select("year", "_n", "_ids")
    found = dealt.mapInArrow(_hashed, "year long, n_open long, state string")
    none = F.lit(state_hash([]))
    return years.join(found, "year", "left").select("year", F.coalesce("n_open", F.lit(0)).cast("long").alias("n_open"), F.coalesce("state", none).alias("state"))


def network_states(projects: DataFrame, years: DataFrame, p: Params, project: str = "project_id", open_year: str = "open_year", corridor: str | None = None) -> DataFrame:
    """states_by_year, within the cap on states: beyond it projects become their corridors, each open with its first
    project; without corridors, or where these are too many too, it raises. States are counted before any is named."""
    cap = int(p.value("access.max_network_states"))
    opened = _opened(projects, project, open_year)
    n = _distinct_states(opened, years)
    if n > cap and corridor is not None:
        whole = projects.groupBy(F.coalesce(c(corridor).cast("string"), c(project).cast("string")).alias("_corridor")).agg(F.min(open_year).alias("_open"))
        opened = _opened(whole, "_corridor", "_open")
        n = _distinct_states(opened, years)
    if n > cap:
        raise NetworkError(f"{n} network states; {cap} are allowed, and corridors that toggle as one may reduce them")
    return _named(opened, years)


def rail_edges(stations: DataFrame, p: Params) -> DataFrame:
    """(u, v, minutes), both ways, of the nodes `line|station` of stations (line, station, place, x, y).

    Neighbours on a line, in the order of place, are joined at line-haul speed with a dwell; nodes of one station, in
    the order of their lines, by a transfer. A line or station is a small group.
    """
    kmh = float(p.value("access.speeds_kmh")["metro_line_haul"])
    dwell, transfer = float(p.value("access.rail.dwell_min")), float(p.value("access.rail.transfer_min"))
    nodes = stations.withColumn("u", F.concat_ws("|", "line", "station"))
    along, across = Window.partitionBy("line").orderBy("place", "station"), Window.partitionBy("station").orderBy("line")
    ride = F.hypot(c("x") - F.lead("x").over(along), c("y") - F.lead("y").over(along)) / 1000 / kmh * 60 + dwell
    edges = nodes.select("u", F.lead("u").over(along).alias("v"), ride.alias("minutes")).unionByName(nodes.select("u", F.lead("u").over(across).alias("v"), F.lit(transfer).alias("minutes"))).filter("v IS NOT NULL")
    return edges.unionByName(edges.select(c("v").alias("u"), c("u").alias("v"), "minutes"))


def shortest_paths(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v, minutes) of the shortest way between any two nodes of edges (u, v, minutes) that one leads between.

    The min-plus closure by repeated squaring: ways found last time are put in front of and behind all, until none is
    shorter, so rounds grow with the logarithm of the longest way. cut writes a round. A node reaches itself in 0; a
    negative edge raises.
    """
    bad = F.when(c("minutes") < 0, F.raise_error(F.lit("an edge takes less than no time")).cast("double")).otherwise(c("minutes"))
    ends = edges.select(c("u")).unionByName(edges.select(c("v").alias("u"))).distinct()
    ways = edges.select("u", "v", bad.alias("minutes")).unionByName(ends.select("u", c("u").alias("v"), F.lit(0.0).alias("minutes")))
    ways = cut(ways.groupBy("u", "v").agg(F.min("minutes").alias("minutes")))
    new = ways
    while True:
        front = new.select("u", c("v").alias("_m"), c("minutes").alias("_d")).join(ways.select(c("u").alias("_m"), "v", "minutes"), "_m")
        behind = ways.select("u", c("v").alias("_m"), c("minutes").alias("_d")).join(new.select(c("u").alias("_m"), "v", "minutes"), "_m")
        longer = front.unionByName(behind).groupBy("u", "v").agg(F.min(c("_d") + c("minutes")).alias("_new"))
        step = ways.join(longer, ["u", "v"], "full").select("u", "v", F.least("minutes", "_new").alias("minutes"), F.coalesce(c("_new") < c("minutes") - 1e-9, c("minutes").isNull()).alias("_shorter"))
        step = cut(step)
        ways, new = step.drop("_shorter"), step.filter("_shorter").drop("_shorter")
        if new.isEmpty():
            return ways


def rail_minutes(stations: DataFrame, p: Params) -> DataFrame:
    """(board, alight, ride): minutes between all (line, station) nodes that rail joins."""
    found = shortest_paths(rail_edges(stations, p), lambda df: kept(df, "ways"))
    return found.select(c("u").alias("board"), c("v").alias("alight"), c("minutes").alias("ride"))


def rail_od(origins: DataFrame, destinations: DataFrame, stations: DataFrame, p: Params, feeders: dict[str, float] | None = None) -> DataFrame:
    """(origin, destination, minutes) by rail: walk, board, ride, change and walk, the least over stations.

    origins (origin, x, y), destinations (destination, x, y), stations as in rail_edges. Walks reach as far as the cap,
    or a feeder station's own reach.
    """
    feeders = feeders or {}
    cap, walk, extra = float(p.value("access.rail.walk_cap_m")), float(p.value("access.speeds_kmh")["walk"]), float(p.value("access.rail.end_extra_min"))
    own = F.create_map(*[F.lit(x) for s, r in feeders.items() for x in (s, float(r))])[c("station")] if feeders else F.lit(None).cast("double")
    table = stations.select(F.concat_ws("|", "line", "station").alias("node"), c("x").alias("sx"), c("y").alias("sy"), F.greatest(F.lit(cap), F.coalesce(own, F.lit(cap))).alias("reach"))
    most = max([cap, *map(float, feeders.values())])

    def leg(points: DataFrame, name: str, node: str, out: str) -> DataFrame:
        near = within(points, table, most, "x", "y", "sx", "sy").filter("dist_m <= reach")
        return near.select(name, c("node").alias(node), (c("dist_m") / 1000 / walk * 60 + extra).alias(out))

    to = leg(origins, "origin", "board", "in_").join(rail_minutes(stations, p), "board").groupBy("origin", "alight").agg(F.min(c("in_") + c("ride")).alias("upto"))
    legs = to.join(leg(destinations, "destination", "alight", "out_"), "alight")
    return legs.groupBy("origin", "destination").agg((F.min(c("upto") + c("out_")) + float(p.value("access.rail.boarding_min"))).alias("minutes"))


def straight_line(p: Params) -> Callable[[DataFrame, DataFrame, str], DataFrame]:
    """A backend: minutes of all pairs by distance and a mode's speed. Destinations are capped (access.max_destinations),
    and each origin meets all of them, as it must: a stated set against all rows."""
    speeds = p.value("access.speeds_kmh")

    def pairs(origins: DataFrame, destinations: DataFrame, mode: str) -> DataFrame:
        metres = F.hypot(c("x") - c("dx"), c("y") - c("dy"))
        to = destinations.select("destination", c("x").alias("dx"), c("y").alias("dy"))
        return origins.join(F.broadcast(to)).select("origin", "destination", (metres / 1000 / float(speeds[mode]) * 60).alias("minutes"))

    return pairs


def with_midpoint_builtup(od: DataFrame, points: DataFrame, cells: DataFrame, start: float | None = None) -> DataFrame:
    """od (origin, destination) with b_mid, the built-up share of the cell nearest the middle of each pair, however far;
    points has (id, x, y) of both ends, cells (cell, x_m, y_m, builtup_frac). A cell without a share counts as 0."""
    a, b = (points.select(c("id").alias(n), c("x").alias(f"{n}_x"), c("y").alias(f"{n}_y")) for n in ("origin", "destination"))
    middle = od.join(a, "origin").join(b, "destination").withColumn("_mx", (c("origin_x") + c("destination_x")) / 2).withColumn("_my", (c("origin_y") + c("destination_y")) / 2)
    # many pairs share a middle to the metre; each is looked up once
    spots = middle.select(F.round("_mx").alias("_rx"), F.round("_my").alias("_ry")).distinct()
    near = nearest_of(spots, ["_rx", "_ry"], cells, "cell", "_rx", "_ry", "x_m", "y_m", lambda df: kept(df, "nearest"), start)
    best = near.join(cells.select("cell", F.coalesce("builtup_frac", F.lit(0.0)).alias("b_mid")), "cell").select("_rx", "_ry", "b_mid")
    out = middle.withColumn("_rx", F.round("_mx")).withColumn("_ry", F.round("_my")).join(best, ["_rx", "_ry"], "left")
    return out.withColumn("b_mid", F.coalesce("b_mid", F.lit(0.0))).drop("_rx", "_ry", "_mx", "_my", "origin_x", "origin_y", "destination_x", "destination_y")


def precompute(origins: DataFrame, destinations: DataFrame, modes: tuple[str, ...], state: str, path: str, backend: Callable[[DataFrame, DataFrame, str], DataFrame], rail: DataFrame | None = None) -> None:
    """Writes a state's table, partitioned by state and mode; the only function that asks a backend. A state that is
    there already is not computed again."""
    spark = origins.sparkSession
    out = None
    for mode in modes:
        rows = backend(origins, destinations, mode).select(F.lit(state).alias("state"), F.lit(mode).alias("mode"), "origin", "destination", c("minutes").cast("double").alias("minutes"))
        out = rows if out is None else out.unionByName(rows)
    if rail is not None:
        rows = rail.select(F.lit(state).alias("state"), F.lit("metro").alias("mode"), "origin", "destination", "minutes")
        out = rows if out is None else out.unionByName(rows)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state={state}")
    if out is not None and not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        out.write.mode("append").partitionBy("state", "mode").parquet(path)


def load_table(spark: SparkSession, path: str, state: str, modes: tuple[str, ...] | None = None) -> DataFrame:
    """A state's table; the partitions of other states and modes are not read. A state that is not there raises."""
    rows = spark.read.parquet(path).filter(c("state") == state)
    if modes:
        rows = rows.filter(c("mode").isin(*modes))
    if rows.isEmpty():
        raise NetworkError(f"no travel times for state {state}")
    return rows.drop("state")


def realigned(result: DataFrame, cells: DataFrame, key: str = "cell") -> DataFrame:
    """All cells with a result's columns: null, not 0, where a cell is no origin."""
    return cells.select(key).join(result, key, "left")


def origins(cells: DataFrame) -> DataFrame:
    """Cells of the city where people live or could: in_city with population or headroom; all of the city if none is."""
    inside = cells.filter("in_city")
    used = (F.coalesce("population", F.lit(0.0)) > 0) | (F.coalesce("headroom_sqm", F.lit(0.0)) > 0)
    any_ = inside.agg(F.coalesce(F.bool_or(used), F.lit(False)).alias("_any"))
    return inside.join(F.broadcast(any_)).filter(used | ~c("_any")).drop("_any")
