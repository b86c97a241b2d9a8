"""Layers of the model against closed forms and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import normal
from terrane.operators import access, allocation as al, credibility as cr, detection, market, measures as ms, networks, shocks, spatial
from terrane.params import ParamError, load_params
from terrane.plans import catalogue_engine as ce
from terrane.plans.views import view
from terrane.sources.ship import kept

SF = "/root/testdata/sf0.001"
P = load_params()


def cut(df):
    return kept(df, "round")


def test_normal(spark):
    from statistics import NormalDist

    n = NormalDist()
    xs = [-40.0, -8.2, -3.1, -0.4, 0.0, 0.7, 2.5, 7.3, 39.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(normal.cdf(F.col("x"))).collect()] == pytest.approx([n.cdf(x) for x in xs], abs=1e-14)
    ps = [1e-12, 0.001, 0.02425, 0.3, 0.5, 0.9, 0.999999]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double")
    got = [r[0] for r in df.select(normal.quantile(F.col("p"))).collect()]
    assert got[:7] == pytest.approx([n.inv_cdf(p) for p in ps], abs=1e-9) and got[7:] == [None] * 3
    u = spark.range(5000).select(normal.uniform(3, "x", F.col("id")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert u[0] == pytest.approx(0.5, abs=0.02) and 0 < u[1] < 0.01 and 0.99 < u[2] < 1


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    parts = [rng.normal(size=501), np.repeat(rng.integers(0, 9, 40), 30).astype(float), rng.lognormal(0, 8, 700), np.array([3.0])]
    for values in parts:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
        wanted = {f"q{i}": ("v", q) for i, q in enumerate((0.0, 0.1, 0.5, 0.777, 1.0))}
        for bins in (4, 4096):
            got = ms.quantiles(df, wanted, bins=bins).first()
            assert list(got) == pytest.approx([float(np.quantile(values, q)) for _, q in wanted.values()], rel=1e-12)
    assert ms.quantiles(df.filter("false"), {"m": ("v", 0.5)}).first()[0] is None


def test_ranks_and_running_totals(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(0, 40)), float(rng.integers(0, 30))) for i in range(900)]
    df = spark.createDataFrame(rows, "cell long, v double, room double")
    got = {r.cell: r.take for r in market.greedy_fill(df, "v", "cell", "room", 4000.0).collect()}
    left = 4000.0
    for i, _, room in sorted(rows, key=lambda r: (-r[1], r[0])):
        assert got[i] == pytest.approx(min(room, left))
        left -= min(room, left)
    assert ms.spearman_p(0.5, 20) == pytest.approx(0.02477, abs=1e-4) and ms.spearman_p(1.0, 9) == 0 and math.isnan(ms.spearman_p(0.5, 2))


def test_knn_however_far(spark):
    rng = np.random.default_rng(2)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 900, (40, 2)))] + [(90, 9000.0, 9000.0), (91, 30000.0, 0.0)]
    df = spark.createDataFrame(points, "cell long, x double, y double")
    got = {}
    for r in spatial.knn(df, "cell", "other", 3, "x", "y", 100.0, cut).collect():
        got.setdefault(r.cell, set()).add(r.other)
    for i, x, y in points:
        near = sorted((math.hypot(x - u, y - v), j) for j, u, v in points if j != i)[:3]
        assert got[i] == {j for _, j in near}
    few = spark.createDataFrame(points[:2], "cell long, x double, y double")
    assert spatial.knn(few, "cell", "other", 3, "x", "y", 1.0, cut).count() == 2


def test_delays(spark):
    rows = [(1, "rail", "2020-02-29", "2024-02-28", ["ec_pending"]), (2, "mega", "2021-01-01", "2023-01-01", None), (3, "rail", "2020-01-01", "2022-01-01", [])]
    df = spark.createDataFrame(rows, "project_id long, archetype string, a string, s string, modifiers array<string>").withColumns({"announced_date": F.to_date("a"), "stated_completion": F.to_date("s")})
    kinds = {"rail": "metro_later", "mega": "govt_mega"}
    got = {r.project_id: r for r in cr.delayed(df, kinds, P).collect()}
    assert got[1].slip == pytest.approx(0.45 * 1.2) and got[3].open_year == pytest.approx(2020 + 731 / 366 * 1.45)
    forced = {r.project_id: r for r in cr.delayed(df, kinds, P, forced={"1": "happens", "2": "fails"}).collect()}
    assert forced[1].slip == 0 and forced[2].open_year is None and forced[3].open_year == got[3].open_year
    many = df.filter("project_id = 3").join(spark.range(4000).withColumnRenamed("id", "draw"))
    slips = [r.slip for r in cr.delayed(many, kinds, P, seed=1, draw="draw").select("slip").collect()]
    assert np.median(slips) == pytest.approx(0.45, rel=0.05) and np.std(np.log(slips)) == pytest.approx(0.5, rel=0.06)
    mega = [r.slip for r in cr.delayed(df.filter("project_id = 2").join(spark.range(4000).withColumnRenamed("id", "draw")), kinds, P, seed=1, draw="draw").select("slip").collect()]
    assert np.mean(np.isclose(mega, 0.15)) == pytest.approx(0.35, abs=0.03)
    x = spark.createDataFrame([(0.0,), (0.15,), (2.0,)], "x double")
    family = P.value("credibility.delay_families")["govt_mega"]
    assert [r[0] for r in x.select(cr.slip_cdf(family, F.col("x"))).collect()] == pytest.approx([0.0, 0.35 + 0.65 * 0.5 * math.erfc(-math.log(0.15 / 2) / 0.8 / math.sqrt(2)), 0.35 + 0.65 * 0.5])
    with pytest.raises(ParamError):
        cr.delayed(df, {"rail": "nowhere"}, P)
    with pytest.raises(Exception, match="no delay family"):
        cr.delayed(df, {"rail": "highway"}, P).collect()
    projects = spark.createDataFrame([(True, None), (False, "verbal")], "is_public boolean, commitment_form string")
    assert cr.check_commitment(projects, P) is projects
    for form in (None, "rumour"):
        with pytest.raises(cr.CommitmentError):
            cr.check_commitment(spark.createDataFrame([(False, form)], "is_public boolean, commitment_form string"), P)


def test_shocks(spark):
    cells = view(spark, SF, "a_cells")
    sites = view(spark, SF, "a_sites").filter("project_id < 300")
    out = ce._effects(sites, cells)
    assert out.employment.filter("is_construction AND dormitory_share <> 0").count() == 0
    jobs = {r.project_id: r.jobs for r in out.employment.filter("NOT is_construction AND sector = 'manuf_light'").collect()}
    for r in out.households.filter("project_id IN (2, 5, 8)").collect():
        assert r.households == pytest.approx(jobs[r.project_id] * 0.7 / 1.45 * 0.35 * 0.5) and r.dormitory_workers == pytest.approx(jobs[r.project_id] * 0.65)
    archetypes, fields, multipliers = ce._tables(sites)
    with pytest.raises(shocks.ShockError):
        shocks.active_projects(sites.withColumn("site", F.col("cell")).withColumn("archetype", F.lit("odd")), archetypes, 2000)
    with pytest.raises(ParamError):
        active = shocks.active_projects(shocks.site_cells(sites, cells), archetypes, 2000)
        shocks.floorspace(active, P)
    assert shocks.floorspace(active, P, "skip").select("use").distinct().collect()[0].use == "dormitory"
    with pytest.raises(Exception, match="unknown target"):
        shocks.field_effects(active.withColumn("flags", F.array().cast("array<string>")), fields.withColumn("target", F.lit("moon")), multipliers, cells, (0.0, 0.0)).collect()
    none = shocks.field_effects(active.withColumn("flags", F.array().cast("array<string>")), fields.filter("false"), multipliers, cells, (0.0, 0.0))
    assert none.count() == 0


def plain_fill(u, demand, headroom, sqm, rounds=50):
    got, rest, active = np.zeros(u.shape), np.array(demand, float), np.isfinite(u).all(axis=1) & (headroom > 0)
    capped = np.zeros(len(u), bool)
    for _ in range(rounds):
        if rest.sum() <= 0 or not active.any():
            break
        e = np.where(active[:, None], np.exp(u - np.where(active[:, None], u, -np.inf).max(axis=0)), 0)
        got = got + e / e.sum(axis=0) * rest
        used = got @ sqm
        over = active & (used > headroom)
        if not over.any():
            rest = np.zeros(len(demand))
            break
        k = np.where(over, headroom / np.where(used > 0, used, 1), 1.0)
        rest = (got * (1 - k)[:, None]).sum(axis=0)
        got, capped, active = got * k[:, None], capped | over, active & ~over
    return got, rest, capped


@pytest.mark.parametrize("scale", [0.2, 30.0])
def test_constrained_fill(spark, scale):
    rng = np.random.default_rng(3)
    n = 30
    u, headroom = rng.normal(size=(n, 4)), rng.uniform(0, 900, n)
    u[4, 2], headroom[7] = np.nan, 0.0
    demand = np.array([10.0, 8.0, 4.0, 2.0]) * scale
    rows = [(i, float(headroom[i]), *[None if np.isnan(v) else float(v) for v in u[i]]) for i in range(n)]
    cells = spark.createDataFrame(rows, "cell long, headroom double, " + ", ".join(f"u_{b} double" for b in al.BANDS))
    one = spark.createDataFrame([tuple(map(float, demand))], ", ".join(f"demand_{b} double" for b in al.BANDS))
    got = {r.cell: r for r in al.allocate_constrained(cells, one, P, cut).collect()}
    sqm = np.array([float(P.value("behaviour.sqm_per_household")[b]) for b in al.BANDS])
    want, rest, capped = plain_fill(np.where(np.isnan(u), -np.inf, u), demand, headroom, sqm)
    for i in range(n):
        assert [got[i][f"got_{b}"] for b in al.BANDS] == pytest.approx(list(want[i]), abs=1e-9) and got[i].capped == capped[i]
    assert [got[0][f"rest_{b}"] for b in al.BANDS] == pytest.approx(list(rest), abs=1e-8)
    assert (rest.sum() > 0) == (scale > 1)


def test_allocation_loop(spark):
    cells = view(spark, SF, "a_bands").filter("cell < 80").fillna({"lna_high": 0.0}).drop(*[f"lna_{b}" for b in al.BANDS]).join(view(spark, SF, "a_cells").select("cell", "com_sqm", "retail_poi", "education_poi", "health_poi", "school_seats", "beds"), "cell")
    effects = view(spark, SF, "a_jobs").filter("cell < 80")
    pairs = access.od_pairs(cells, access.destinations(cells, "zone", "jobs", 25, 50).drop("jobs"), "cell", "zone")
    od = kept(pairs.select("cell", "zone", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), access.minutes(F.col("dist_m"), v).alias("minutes")) for m, v in (("car", 26.0), ("walk", 4.5), ("transit", 18.0), ("two_wheeler", 26.0))])).alias("m")).select("cell", "zone", "m.*"), "od")
    opp = lambda x: access.opportunities(x, "zone", P)
    out = al.allocate(cells, od, "zone", opp, effects, 1997, P, cut, {"low": 5.0, "mid": 4.5, "upper_mid": 4.0, "high": 3.5}, growth=0.02)
    assert out.iterations == len(out.steps) <= 12 and out.steps[-1] < 0.005 and all(a >= b for a, b in zip(out.steps, out.steps[1:]))
    demand = al.household_demand(cells, effects, 1997, P, 0.02).first()
    got = out.cells.agg(*[F.sum(f"got_{b}").alias(b) for b in al.BANDS]).first()
    for b in al.BANDS:
        assert got[b] + out.spill[b] == pytest.approx(demand[f"demand_{b}"], rel=1e-6)
    grown = out.cells.join(cells.select("cell", F.col("households").alias("h0"), F.col("jobs").alias("j0"), F.col("population").alias("p0")), "cell")
    off = grown.agg(F.max(F.abs(F.col("households") - F.col("h0") - sum((F.col(f"got_{b}") for b in al.BANDS), F.lit(0.0)))), F.min(F.col("jobs") - F.col("j0")), F.max(F.abs(F.col("population") - F.col("p0") - F.col("residents")))).first()
    assert off[0] < 1e-9 and off[1] >= 0 and off[2] < 1e-9
    with pytest.raises(al.ConvergenceError):
        al.allocate(cells, od, "zone", opp, effects, 1997, P.with_values({"behaviour.max_iterations": 1, "behaviour.convergence_tol": 1e-12}), cut, {"low": 5.0, "mid": 4.5, "upper_mid": 4.0, "high": 3.5}, growth=0.02)
    with pytest.raises(ParamError):
        al.household_demand(cells, effects, 1997, P)


def test_networks(spark, tmp_path):
    years = spark.range(2000, 2010).withColumnRenamed("id", "year")
    projects = spark.createDataFrame([(i, 2000.0 + i, i % 2) for i in range(6)] + [(9, None, 0)], "project_id long, open_year double, line long")
    states = networks.network_states(projects, years, P).orderBy("year").collect()
    assert [r.n_open for r in states] == [1, 2, 3, 4, 5, 6, 6, 6, 6, 6] and len({r.state for r in states}) == 6
    tight = P.with_values({"access.max_network_states": 3})
    with pytest.raises(networks.NetworkError):
        networks.network_states(projects, years, tight)
    fewer = networks.network_states(projects, years, tight, corridor="line").orderBy("year").collect()
    assert [r.n_open for r in fewer][:3] == [1, 2, 2] and len({r.state for r in fewer}) == 2
    rows = [("a", "red", 1, 0.0, 0.0), ("b", "red", 2, 3200.0, 0.0), ("b", "blue", 1, 3200.0, 0.0), ("c", "blue", 2, 3200.0, 6400.0), ("z", "far", 1, 9e5, 9e5)]
    stations = spark.createDataFrame(rows, "station string, line string, place long, x double, y double")
    ride = {(r.board, r.alight): r.ride for r in networks.rail_minutes(stations, P).collect()}
    assert ride["red|a", "red|b"] == pytest.approx(6.5) and ride["red|a", "blue|c"] == pytest.approx(6.5 + 3 + 12.5) and ("red|a", "far|z") not in ride
    here = spark.createDataFrame([("o", 0.0, 750.0), ("lost", 0.0, 5000.0)], "origin string, x double, y double")
    there = spark.createDataFrame([("d", 3200.0, 6400.0)], "destination string, x double, y double")
    got = networks.rail_od(here, there, stations, P).collect()
    assert [(r.origin, r.destination) for r in got] == [("o", "d")] and got[0].minutes == pytest.approx(10 + 1 + 22 + 0 + 1 + 3)
    fed = networks.rail_od(here, there, stations, P, {"a": 6000.0}).collect()
    assert {r.origin for r in fed} == {"o", "lost"}
    path = str(tmp_path / "od")
    for state in ("s1", "s2", "s1"):
        networks.precompute(here, there, ("car", "walk"), state, path, networks.straight_line(P), networks.rail_od(here, there, stations, P))
    table = networks.load_table(spark, path, "s1", ("car",))
    assert table.count() == 2 and networks.load_table(spark, path, "s2").count() == 5
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    with pytest.raises(networks.NetworkError):
        networks.load_table(spark, path, "s3")


def test_price_paths(spark):
    cells = spark.createDataFrame([(1, 1.5, 100.0, 50.0, 10.0), (2, 0.1, 0.0, 0.0, 10.0)], "cell long, eps double, quantity double, headroom_sqm double, households double").withColumn("d_lna", F.lit(0.2))
    draws = spark.range(300).withColumnRenamed("id", "draw")
    got = market.price_paths(cells, draws, [2026, 2030], 2024, P, 5)
    spread = {(r.cell, r.year): r.s for r in got.groupBy("cell", "year").agg(F.stddev("log_change").alias("s")).collect()}
    assert all(spread[k, 2030] > 1.4 * spread[k, 2026] for k in (1, 2))
    few = market.price_paths(cells, spark.range(3).withColumnRenamed("id", "draw"), [2026, 2030], 2024, P, 5)
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(few) == order(got.filter("draw < 3"))
    fixed = market.price_paths(cells, draws.limit(1), [2025], 2024, P.deterministic(), 5).filter("cell = 1").first()
    assert fixed.log_change == pytest.approx(0.055 + 0.25 * 0.2 / 2.15)
    with pytest.raises(ValueError, match="years"):
        market.price_paths(cells, draws, [2024], 2024, P, 5)


def test_detection(spark):
    months = [f"2020-{m:02d}-01" for m in range(1, 13)]
    path = [0.5, 0.5, 0.5, 0.5, 0.5, 0.2, 0.2, 0.2, 0.2, 0.2, 0.5, 0.5]
    ndbi = [0.0] * 7 + [0.2] * 3 + [0.0] * 2
    rows = [("p", m, v, b, 0.1 if i == 6 else 0.0, 0.1, 0.0, i != 2, 10.0 if i < 8 else 14.0) for i, (m, v, b) in enumerate(zip(months, path, ndbi))]
    rows += [("thin", m, 0.5, 0.0, 0.0, 0.1, 0.0, i < 2, 1.0) for i, m in enumerate(months)]
    df = spark.createDataFrame(rows, "project_id string, m string, ndvi double, ndbi double, bsi double, brightness double, cloud_frac double, valid boolean, light double").withColumn("month", F.to_date("m")).drop("m")
    projects = spark.createDataFrame([("p",), ("thin",)], "project_id string").withColumn("announced_date", F.to_date(F.lit("2020-06-01")))
    with pytest.raises(detection.BaselineError):
        detection.detect(df, projects, P)
    got = detection.detect(df, projects, P, "skip").orderBy("month").collect()
    assert [r.state for r in got] == ["none", "none", None, "none", "none", "cleared", "earthworks", "structure", "operational", "operational", "none", "none"]
    assert [r.state_cum for r in got][-2:] == ["operational"] * 2 and got[2].state_cum is None
    last = detection.latest_states(detection.detect(df, projects, P, "skip")).first()
    assert (last.project_id, last.physical_state, str(last.physical_asof)) == ("p", "operational", "2020-12-01")
    west, south, east, north = detection.aoi_bounds(83.0, 17.6, 83.1, 17.7, 500.0)
    assert (83.0 - west) * 111320 * math.cos(math.radians(17.7)) == pytest.approx(500, rel=0.01) and (north - 17.7) * 110650 == pytest.approx(500, rel=0.01)
    with pytest.raises(ValueError, match="bounds"):
        detection.aoi_bounds(10, 0, 5, 1, 1.0)


def test_city(spark):
    """Two years through all layers; projects raise the price where they are, and a network that opens does so everywhere."""
    few = "cell < 60"
    base = view(spark, SF, "a_bands").filter(few).drop(*[f"lna_{b}" for b in al.BANDS], "headroom", "field")
    base = base.join(view(spark, SF, "a_cells").filter(few).select("cell", "com_sqm", "retail_poi", "education_poi", "health_poi", "school_seats", "beds", "absorbed", "inventory", F.col("res_sqm").alias("built")), "cell").withColumn("eps", F.lit(1.0))
    cells = kept(base.fillna({"price": 900.0}), "cells")
    flags = F.array_compact(F.array(F.when(F.col("interchange"), "interchange")))
    sites = view(spark, SF, "a_sites").filter("project_id < 90").withColumn("flags", flags).withColumn("p_completion", F.lit(0.8)).withColumn("open_year", F.lit(1999.5)).withColumn("construction_start", F.lit(1998.0)).withColumn("announced_year", F.lit(1997.0))
    pairs = access.od_pairs(cells, access.destinations(cells, "zone", "jobs", 25, 50).drop("jobs"), "cell", "zone")
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), access.minutes(F.col("dist_m"), v).alias("minutes")) for m, v in (("car", 26.0), ("walk", 4.5), ("transit", 18.0), ("two_wheeler", 26.0))])).alias("m")
    slow = kept(pairs.select("cell", "zone", modes).select("cell", "zone", "m.*"), "od")
    quick = slow.withColumn("minutes", F.when(F.col("mode") == "transit", F.col("minutes") / 2).otherwise(F.col("minutes")))
    tables = ce._tables(sites)
    persons = {"low": 5.0, "mid": 4.5, "upper_mid": 4.0, "high": 3.5}
    from terrane.plans import city

    run = lambda projects, od: city.simulate(city.City(cells, projects, *tables, od, (10000.0, 10000.0)), (2000, 2001), P, persons, 0.02)
    full = run(sites, lambda year: slow if year == 2000 else quick)
    none = run(sites.filter("false"), lambda year: slow)
    mean = lambda r, y: r.panel.filter(F.col("year") == y).agg(F.avg("d_ln_p")).first()[0]
    assert full.panel.count() == 2 * cells.count() and [y.year for y in full.years] == [2000, 2001]
    lifted = full.panel.filter("year = 2000 AND field > 0.05").join(none.panel.filter("year = 2000").select("cell", F.col("d_ln_p").alias("d0")), "cell")
    assert lifted.filter("d_ln_p <= d0").count() == 0 and lifted.count() > 0
    assert mean(full, 2001) > mean(none, 2001) and full.years[1].delivered > 0


def test_resolved_effects(spark):
    """Effects by archetype for two scenarios at once, and a run with them."""
    from terrane.operators import substrate
    from terrane.plans import simulation

    cells = kept(substrate.substrate(view(spark, SF, "a_cells"), P).filter("cell < 60"), "cells")
    sites = view(spark, SF, "a_sites").filter("project_id < 60").withColumn("flags", F.array().cast("array<string>")).withColumn("p_completion", F.lit(0.5))
    sites = sites.withColumns({"open_year": F.lit(2000.0), "construction_start": F.lit(1999.0), "construction_year": F.lit(1999.0), "announced_year": F.lit(1998.0)}).drop("weight")
    years = simulation.horizon(2000, 2001)
    scenarios = [simulation.Scenario("full", years), simulation.Scenario("no_plants", years, tuple(range(2, 60, 3)))]
    effect = simulation.resolved_effects(sites, *ce._tables(sites), cells, scenarios, P, (10000.0, 10000.0))
    by = {(r.scenario, r.year): r for r in effect.groupBy("scenario", "year").agg(F.sum("new_jobs").alias("j"), F.sum("field").alias("f")).collect()}
    assert by["full", 2000].j > 0 and by["full", 2001].j > by["no_plants", 2001].j > 0 and by["full", 2001].f < by["no_plants", 2001].f
    alone = ce.shocks.resolve(cr.activation(sites, spark.createDataFrame([(2001,)], "year long"), P).drop("year"), *ce._tables(sites), cells, 2001, P, (10000.0, 10000.0), "skip")
    assert by["full", 2001].f == pytest.approx(alone.fields.filter("target = 'residential'").agg(F.sum("value")).first()[0])
    panel = simulation.run(cells, sites, scenarios, P, effect=effect).panel
    assert panel.count() == 4 * cells.count()
    gap = panel.filter("year = 2001").groupBy("scenario").agg(F.sum("households").alias("h")).collect()
    assert {r.scenario: r.h for r in gap}["full"] > {r.scenario: r.h for r in gap}["no_plants"]
