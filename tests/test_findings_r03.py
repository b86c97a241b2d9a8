"""What the third round of findings showed: plans that do not broadcast what grows, whole jobs, ties."""

import contextlib
import datetime as dt
import io
import math

import pytest
from pyspark.sql import functions as F

from terrane.operators import allocation, cell_columns, cover, detection, hedonic, networks, shocks, spatial
from terrane.params import load_params
from terrane.plans import catalogue_shapes
from terrane.sources.ship import kept

P = load_params()


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def grid(spark):
    return kept(spark.range(400).select(F.col("id").alias("cell"), (F.col("id") % 20 * 500.0).alias("x_m"), (F.floor(F.col("id") / 20) * 433.0).alias("y_m"), (F.col("id") % 7 * 1.0).alias("v")), "grid")


def test_distance_joins_do_not_broadcast(grid):
    points = grid.select(F.col("cell").alias("other"), F.col("x_m").alias("px"), F.col("y_m").alias("py"))
    pairs = spatial.within(grid, points, 600.0, "x_m", "y_m", "px", "py")
    assert "BroadcastExchange" not in plan(pairs)
    assert pairs.filter("cell = 21").count() == 5  # itself, two beside, two above and below
    weights = spatial.knn_weights(spatial.knn(grid, "cell", "other", 4, "x_m", "y_m", 1500.0, lambda df: kept(df, "round")), "cell", "other", 4)
    assert weights.count() == 1600
    assert "BroadcastHashJoin" not in plan(hedonic.lagged(grid, weights, "cell", "other", ["v"]))


def test_states_of_many_projects(spark, monkeypatch):
    projects = spark.range(150_000).select(F.col("id").alias("project_id"), (1998.5 + F.col("id") % 6).alias("open_year"), (F.col("id") % 3).alias("line"))
    years = spark.range(1997, 2006).withColumnRenamed("id", "year")
    got = {r.year: (r.n_open, r.state) for r in networks.network_states(projects, years, P).collect()}
    assert len(got) == 9 and got[1997] == got[1998] == (0, networks.state_hash([]))
    assert got[2000] == (50_000, networks.state_hash([str(i) for i in range(150_000) if i % 6 < 2])) and got[2004] == got[2005] == (150_000, networks.state_hash([str(i) for i in range(150_000)]))
    # every year of the first six is a state of its own; corridors open together are few, however many projects are open
    tight = P.with_values({"access.max_network_states": 4})
    lines = {r.year: r.n_open for r in networks.network_states(projects, years, tight, corridor="line").collect()}
    assert lines[1998] == 0 and lines[1999] == 1 and lines[2001] == lines[2005] == 3
    odd = spark.createDataFrame([('a"b', 1999.0), ("é\\", 1999.0), ("B", 2000.0)], "project_id string, open_year double")
    assert {r.year: r.state for r in networks.network_states(odd, years, P).collect()}[2000] != networks.state_hash(["B"])


def months(spark, rows):
    return spark.createDataFrame([(i, dt.date(1995, m, 1), ndvi, ndbi, bsi, True, 1.0) for i, m, ndvi, ndbi, bsi in rows], "project_id long, month date, ndvi double, ndbi double, bsi double, valid boolean, light double")


def test_detection_at_a_threshold(spark):
    """0.4 is 0.1 above a baseline of 0.3, and no more, whatever the mean's last digit."""
    rows = [(1, m, 0.5, v, 0.1) for m, v in ((1, 0.1), (2, 0.2), (3, 0.6), (6, 0.1 + 0.3 + 1e-16))] + [(2, m, 0.5, v, 0.1) for m, v in ((1, 0.3), (2, 0.3), (3, 0.3), (6, 0.40000000000000013), (7, 0.41))]
    m = months(spark, rows)
    projects = m.select("project_id").distinct().withColumn("announced_date", F.lit("1995-06-01").cast("date"))
    got = {(r.project_id, r.month.month): r.state for r in detection.detect(m, projects, P, "skip").collect()}
    assert got[1, 6] == got[2, 6] == "none" and got[2, 7] == "structure"


def test_projects_without_a_baseline(spark):
    m = months(spark, [(1, k, 0.5, 0.1 if k < 6 else 0.9, 0.1) for k in range(1, 8)] + [(2, 4, 0.5, 0.1, 0.1), (2, 7, 0.5, 0.9, 0.1)])
    projects = m.select("project_id").distinct().withColumn("announced_date", F.lit("1995-06-01").cast("date"))
    with pytest.raises(detection.BaselineError):
        detection.detect(m, projects, P)
    found = detection.latest_states(detection.detect(m, projects, P, "null")).collect()
    assert {r.project_id: (r.physical_state, r.physical_asof.month) for r in found} == {1: ("structure", 7), 2: ("none", 4)}


def test_sat_queries_take_thin_projects(spark, tmp_path):
    """Months too few for a baseline stop no query: where its SQL leaves them out, so does the query."""
    days = [(i, i % 2, i % 3, dt.datetime(1995, 1 + i % 5, 3)) for i in range(40)] + [(50, 9, 9, dt.datetime(1995, 2, 1))]
    rows = spark.createDataFrame([(o * 5, p, s, 1.0, 2.0, d) for o, p, s, d in days], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = {n: catalogue_cells_queries()[n](spark, str(tmp_path)).collect() for n in ("sat_baseline", "sat_detect", "sat_latest_state")}
    assert {r.project_id for r in rows["sat_baseline"]} == {r.project_id for r in rows["sat_detect"]} == {0, 1, 2}
    assert {r.project_id: r.physical_state for r in rows["sat_latest_state"]}[9] == "none" and len(rows["sat_latest_state"]) == 3


def catalogue_cells_queries():
    from terrane.plans import queries

    return queries.queries()


def test_effects_do_not_wait_for_fields(spark):
    """Tables without shapes ask for no shape: only fields may meet the cells around a project."""
    made = []
    effects = shocks.Effects(None, None, None, None, None, lambda: made.append(1) or "fields")
    assert effects.supply is None and made == [] and effects.fields == effects.fields == "fields" and made == [1]


def test_small_and_large_shapes_alike(spark, grid):
    """Shapes that go to their squares whole meet the cells that pieces of them meet, at the same distances."""
    ring = [(900.0, 900.0), (2600.0, 1000.0), (1500.0, 1400.0), (2400.0, 2700.0), (1000.0, 2500.0)]
    rows = [("line", ring, False), ("ring", ring, True), ("point", [(700.0, 800.0)], False)]
    shapes = kept(spark.createDataFrame(rows, f"project_id string, shape array<{cover.POINT}>, area boolean"), "shapes")
    small = cover.near_small_shapes(grid, shapes, ["cell"], ["project_id"], 1000.0, "x_m", "y_m", lambda df: kept(df, "near"))
    got = {(r.cell, r.project_id): round(r.dist_m, 6) for r in small.collect()}
    assert got == {(r.cell, r.project_id): round(r.dist_m, 6) for r in shocks.cells_near(shapes, grid, 1000.0).collect()}
    assert small.count() == len(got) and 0.0 in {d for (_, p), d in got.items() if p == "ring"}
    assert "Window" not in plan(small) and "Aggregate" not in plan(small)


def test_project_cells_ask_once_for_a_place_and_a_ring(spark, monkeypatch):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    cells = spark.range(30).select(F.col("id").alias("cell"), F.array(corner(0.0, 0.0), corner(100.0, 0.0), corner(100.0, 100.0), corner(0.0, 100.0)).alias("ring"))
    projects = spark.range(50).select(F.col("id").alias("project_id"), F.lit(50.0).alias("x"), F.lit(40.0).alias("y"))
    asked, own = [], cell_columns.inside_polygons
    monkeypatch.setattr(cell_columns, "inside_polygons", lambda points, polygons, *a: asked.append((points.count(), polygons.count())) or own(points, polygons, *a))
    assert {(r.project_id, r.cell) for r in cell_columns.project_cells(projects, cells).collect()} == {(i, 0) for i in range(50)} and asked == [(1, 1)]


def test_districts_are_many_tasks(spark):
    """Overlays and formats are worked out where districts are, and neither side of an overlay is broadcast."""
    d = kept(spark.range(100).selectExpr("id AS zone_id", "id * 50e0 AS x0", "0e0 AS y0", "400e0 AS wide", "300e0 AS high", "id * 50e0 AS rx0", "0e0 AS ry0", "id * 50e0 + 1 AS rx1", "1e0 AS ry1", "id % 3 AS form").coalesce(1), "districts")
    assert catalogue_shapes.districts(d).rdd.getNumPartitions() == 4
    x = spark.range(50).select(F.col("id").alias("cell"), (F.col("id") * 100.0).alias("x_m"), F.lit(100.0).alias("y_m"))
    assert "BroadcastHashJoin" not in plan(catalogue_shapes.shared(d, kept(x, "cells")))


def test_band_access_has_one_row_a_pair(spark):
    """Modes are sums over a pair's one row, and opportunities join destinations before pairs are made."""
    got = plan(catalogue_cells_queries()["l5_band_accessibility"](spark, "/root/testdata/sf0.001"))
    first = next(r for r in got.split("\n") if "Join" in r)  # the last step that joins
    assert "Generate" not in got and "BroadcastNestedLoopJoin" in first
    kmh = {m: float(P.value("access.speeds_kmh")[m]) for m in ("car", "transit", "two_wheeler", "walk")}
    rows = [(i, z, None if i == 3 and z == 1 else 700.0 * i + 90.0 * z) for i in range(5) for z in range(4)] + [(9, 1, None)]
    pairs = spark.createDataFrame(rows, "cell long, zone long, dist_m double")
    opp = spark.createDataFrame([(z, 100.0 * z, 50.0, None if z == 2 else 7.0, 3.0 + z) for z in range(4)], "zone long, o_work double, o_retail double, o_education double, o_health double")
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(v).alias("kmh")) for m, v in kmh.items()])).alias("m")
    od = pairs.select("cell", "zone", "dist_m", modes).select("cell", "zone", "m.mode", (F.col("dist_m") / 1000 / F.col("m.kmh") * 60).alias("minutes"))
    want = {r.cell: pytest.approx(tuple(r)[1:], rel=1e-12) for r in allocation.band_accessibility(od, opp, "cell", "zone", P).collect()}
    assert {r.cell: tuple(r)[1:] for r in allocation.band_gravity(pairs.join(opp, "zone"), "cell", kmh, P).collect()} == want and len(want) == 6


def test_far_points_do_not_meet_all_sites(spark):
    """A square of many far points is dealt out, its points and their sites are not sorted, and ties go by candidate."""
    sites = [(f"s{i:03}", i % 20 * 500.0, i // 20 * 433.0) for i in range(300)]
    points = [(i, i % 40 * 250.0 - 10.0 * (i % 3), 3e6 + i // 40 * 433.0) for i in range(400)] + [(900, 250.0, -5e5), (901, 9e5, 700.0), (902, float("nan"), 0.0)]
    own = spark.createDataFrame(points, "k long, _x double, _y double").repartition(3)
    them = spark.createDataFrame(sites, "site string, _sx double, _sy double")
    asked = spatial._ask(own, ["k"], them, "site", 4e6, held=50)
    assert "SortAggregate" not in plan(asked) and "BroadcastNestedLoopJoin" not in plan(asked)
    apart = lambda x, y, u, v: math.sqrt((x - u) * (x - u) + (y - v) * (y - v))
    want = {k: min((apart(x, y, u, v), s) for s, u, v in sites) for k, x, y in points[:-1]}
    assert {r.k: (r.dist_m, r.site) for r in asked.filter("k < 902").collect()} == want and want[900][1] == "s000" and want[1][1] == "s280"
    whole = spatial.nearest_of(own, ["k"], them, "site", "_x", "_y", "_sx", "_sy", lambda df: kept(df, "nearest"), 5e5)
    assert {r.k: (r.dist_m, r.site) for r in whole.collect()} == want
