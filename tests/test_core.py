"""The library without its optional subpackage."""

import importlib.util
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import scalar as sc
from terrane.operators import access, cascade, credibility, ensemble, govern, hedonic, ingest, market, measures, spatial, substrate
from terrane.params import ParamError, load_params
from terrane.plans import catalogue, simulation
from terrane.plans import queries as every
from terrane.plans.views import table, view
from terrane.schema import CELLS_HISTORY, ANNOUNCERS, SchemaError
from terrane.sources.readers import FileReader, MemoryReader, adapter_for
from terrane.sources.store import Store, StoreError, content_hash, open_snapshot

SF = "/root/testdata/sf0.001"
P = load_params()


def one(spark, **values):
    return spark.range(1).select(*[(F.lit(v) if not isinstance(v, F.Column) else v).alias(k) for k, v in values.items()]).first()


def norm(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(every.oracle_sql()))
def test_query_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "part lineitem orders customer supplier nation events conversations documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = every.queries()[name](spark, SF)
    rel = con.execute(every.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    there = sorted((tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall()), key=repr)
    here = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    assert here == there


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(every.queries()) <= set(entry.queries()) and set(every.queries()) == set(every.oracle_sql())
    assert (importlib.util.find_spec("terrane.llm") is None) == (not any(n.startswith("op1_") for n in entry.queries()))


def test_params():
    assert load_params({"supply.elasticity.dense_core": 0.10}).value("supply.elasticity.dense_core") == 0.10
    for bad in ({"price.eta": 1.0}, {"nowhere": 1}):
        with pytest.raises(ParamError):
            load_params(bad)
    with pytest.raises(ParamError):
        load_params(global_overrides={"price.eta": {"value": 0.7}})
    fixed = load_params(global_overrides={"price.eta": {"value": 0.7, "reason": "r", "approved_by": "a", "date": "2024-01-01"}})
    assert fixed.value("price.eta") == 0.7 and fixed.hash() != P.hash() and P.hash() == load_params().hash()
    rng = np.random.default_rng(0)
    drawn = [P.sample("access.congestion.k", rng) for _ in range(200)]
    assert 0.20 <= min(drawn) < 0.25 and 0.45 < max(drawn) <= 0.50 and P.sample("price.phi_bull", rng) == P.value("price.phi_bull") and P.deterministic().sample("price.eta", rng) == 0.65


def test_scalar(spark):
    got = one(spark, a=sc.field_decay("linear", F.lit(1.0), F.lit(2000.0), 1000), b=sc.wedge(*[F.lit(v) for v in (0.0, 0.0, 0.0, 0.0, 5.0, 5.0)], 0.5), c=sc.digitize(F.lit(75000.0), [25000, 75000, 200000]))
    assert (got.a, got.b, got.c) == (0.0, 1.0, 2)
    assert str(one(spark, q=sc.quarter_end(F.lit("FY2024 Q3"))).q) == "2024-09-01" and one(spark, q=sc.quarter_end(F.lit("soon"))).q is None
    ring = "array(struct(0d x, 0d y), struct(4d x, 0d y), struct(4d x, 3d y), struct(0d x, 3d y))"
    got = one(spark, a=sc.ring_area(F.expr(ring)), i=sc.in_ring(F.lit(1.0), F.lit(1.0), F.expr(ring)), o=sc.in_ring(F.lit(5.0), F.lit(1.0), F.expr(ring)), d=sc.segment_distance(F.lit(2.0), F.lit(7.0), F.expr(ring)))
    assert got.a == pytest.approx(12) and got.i and not got.o and got.d == pytest.approx(4)
    x, y = sc.utm(F.lit(81.0), F.lit(0.0), 44)
    assert one(spark, x=x, y=y).x == pytest.approx(500000) and one(spark, x=x, y=y).y == pytest.approx(0)
    x2, y2 = sc.utm(F.lit(83.2), F.lit(17.7), 44)
    got = one(spark, x=x2, y=y2)
    assert got.x == pytest.approx(733308, abs=3000) and got.y == pytest.approx(1958000, abs=3000)


def test_substrate(spark):
    cells = spark.createDataFrame([(10.0, 0.1, 1, 1, 1, 1000.0, 2.0, 9000.0, 100.0, 0.0, 0.2), (20.0, 0.1, 1, 1, 1, 1000.0, 2.0, 9000.0, 0.0, 0.0, 0.2)], "slope_pct double, undevelopable_frac double, util_water int, util_sewer int, util_power int, area_sqm double, permitted_far double, mean_parcel_sqm double, res_sqm double, com_sqm double, builtup_frac double")
    a, b = substrate.substrate(cells, P).collect()
    assert a.capacity_sqm == pytest.approx(1800) and a.headroom_sqm == pytest.approx(1700) and b.capacity_sqm == 0 and b.slope_cost == float("inf") and b.elasticity_class == "constrained_periph"
    rng = np.random.default_rng(0)
    rows = [(float(x), float(y), 1 + 2 * float(x) - float(y)) for x, y in rng.normal(size=(200, 2))]
    fit = substrate.fit_log_elasticity(spark.createDataFrame(rows, "x double, y double, z double"), "z", ["x", "y"], 0.05)
    assert fit["intercept"] == pytest.approx(1) and fit["x"] == pytest.approx(2) and fit["y"] == pytest.approx(-1) and fit["r2"] == pytest.approx(1)


def test_spatial_against_brute_force(spark):
    rng = random.Random(0)
    left, right = ([(i, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for i in range(n)] for n in (80, 60))
    a, b = spark.createDataFrame(left, "a long, ax double, ay double"), spark.createDataFrame(right, "b long, bx double, by double")
    got = {(r.a, r.b) for r in spatial.within(a, b, 700.0, "ax", "ay", "bx", "by").collect()}
    assert got == {(i, j) for i, x, y in left for j, u, v in right if math.hypot(x - u, y - v) <= 700}


def _points(spark, sf):
    """Cells and sites of the given tables, as {id: (x, y)}."""
    cells = {r.cell: (r.x_m, r.y_m) for r in view(spark, sf, "a_cells").select("cell", "x_m", "y_m").collect()}
    sites = {r.project_id: cells[r.cell] for r in view(spark, sf, "a_projects").select("project_id", "cell").collect() if r.cell in cells}
    return cells, sites


def test_nearest_site_at_any_distance(spark):
    sf = "/root/testdata/sf0.01"
    cells, sites = _points(spark, sf)
    at = {}
    for i in sorted(sites, reverse=True):
        at[sites[i]] = i
    best = {k: min((math.hypot(x - u, y - v), i) for (u, v), i in at.items()) for k, (x, y) in cells.items()}
    want = {k: (i, pytest.approx(d, abs=1e-6)) for k, (d, i) in best.items()}
    assert {r.cell: (r.project_id, r.dist_m) for r in catalogue.queries()["l2_nearest_site"](spark, sf).collect()} == want and len(want) == 2000


def test_wedge_within_1000_m(spark):
    cells, sites = _points(spark, SF)
    want = {(j, i) for i, (x, y) in cells.items() for j, (u, v) in sites.items() if math.hypot(x - u, y - v) <= 1000}
    got = [(r.project_id, r.cell) for r in catalogue.queries()["l2_wedge"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_rail_walks_of_1500_m(spark):
    cells, _ = _points(spark, SF)
    stations = [r.cell for r in view(spark, SF, "a_cells").filter("brand = 'Brand#13'").collect()]
    apart = lambda a, b: math.hypot(cells[a][0] - cells[b][0], cells[a][1] - cells[b][1])
    near = {s: [(i, apart(i, s)) for i in cells if apart(i, s) <= 1500] for s in stations}
    want = {}
    for a in stations:
        for b in stations:
            if a != b and apart(a, b) <= 2500:
                for i, p in near[a]:
                    for j, q in near[b]:
                        want[i, j] = min(want.get((i, j), math.inf), p / 75 + apart(a, b) / 533 + q / 75 + 6)
    got = {(r.origin, r.destination): r.minutes for r in catalogue.queries()["l1_rail_min_plus"](spark, SF).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_destinations(spark):
    sf = "/root/testdata/sf0.01"
    jobs = {}
    for r in view(spark, sf, "a_cells").select("zone", "jobs").collect():
        jobs[r.zone] = jobs.get(r.zone, 0.0) + r.jobs
    want = [z for z in sorted(jobs, key=lambda z: (-jobs[z], z)) if jobs[z] >= 25][:1500]
    assert [r.zone for r in catalogue.queries()["l1_destinations"](spark, sf).collect()] == want and len(want) == 286
    few = spark.createDataFrame([(1, 3.0, 0.0, 0.0), (1, 4.0, 2.0, 2.0), (2, 9.0, 1.0, 1.0), (3, 9.0, 1.0, 1.0), (4, None, 0.0, 0.0)], "zone long, jobs double, x_m double, y_m double")
    pick = lambda least, limit=9, df=few: [r.zone for r in access.destinations(df, "zone", "jobs", least, limit).collect()]
    assert pick(25) == [2, 3, 1, 4] and pick(25, 2) == [2, 3] and pick(9) == [2, 3] and pick(25, df=few.filter("zone = 4")) == [4] and pick(25, df=few.limit(0)) == []


def test_access(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 3000.0, 4000.0)], "cell long, x_m double, y_m double")
    zones = spark.createDataFrame([(7, 0.0, 0.0, 50.0), (8, 3000.0, 0.0, 100.0), (9, None, 0.0, 1e9)], "zone long, x_m double, y_m double, o_work double")
    pairs = access.od_pairs(cells, zones, "cell", "zone")
    assert pairs.count() == 6
    got = {r.cell: r.lna for r in access.gravity(pairs, "cell", {"car": 60.0}, {"car": 0.5}, {"work": {"car": 0.1}}, {"work": 1.0}).collect()}
    assert got[1] == pytest.approx(math.log1p(0.5 * (50 + 100 * math.exp(-0.3)))) and got[2] == pytest.approx(math.log1p(0.5 * (50 * math.exp(-0.5) + 100 * math.exp(-0.4))))
    assert {r.cell: r.jobs_4 for r in access.reachable(pairs, "cell", {"car": 60.0}, {"car": 0.5}, "o_work", [4]).collect()} == {1: 75.0, 2: 50.0}


def test_credibility():
    assert credibility.slip_median({"median": 0.6}) == 0.6 and credibility.slip_median({"fast_p": 0.6, "fast_slip": 0.1}) == 0.1
    assert credibility.slip_median({"fast_p": 0.35, "fast_slip": 0.15, "slow_slip": 2.0, "sigma": 0.8}) == pytest.approx(2 * math.exp(0.8 * sc.normal_quantile(0.15 / 0.65)))


def cut(df):
    return spark_rows(df)


def spark_rows(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_fill(spark):
    cells = spark.createDataFrame([(1, 0.5, 100.0), (2, 0.3, 1000.0), (3, 0.2, 1000.0)], "cell long, weight double, headroom double")
    got = {r.cell: r for r in market.fill(cells, 30.0, 10.0, cut).collect()}
    assert got[1].got == 10 and sum(r.got for r in got.values()) == pytest.approx(30) and got[2].got / got[3].got == pytest.approx(1.5)
    full = market.fill(cells, 1e4, 10.0, cut).collect()
    assert sum(r.got for r in full) == pytest.approx(210) and full[0].rest > 0


def test_clearing(spark):
    base = dict(d_ln_d=0.1, d_ln_s0=0.0, eps=1.5, quantity=1000.0, headroom_sqm=1e9, cap=1e9)
    rows = spark.createDataFrame([{**base, "k": 0}, {**base, "k": 1, "headroom_sqm": 0.0}, {**base, "k": 2, "quantity": 0.0}])
    got = {r.k: r for r in market.clear_market(rows, P, 0.0).collect()}
    assert got[0].d_ln_p == pytest.approx(0.1 / 2.15) and got[0].d_ln_q == pytest.approx(1.5 * 0.1 / 2.15)
    assert got[1].d_ln_q == 0 and got[1].d_ln_p == pytest.approx(0.1 / 0.65) and got[2].d_ln_q == 0


def test_copula(spark):
    assert ensemble.beta_cdf(0.3, 2, 5) == pytest.approx(0.579825, abs=1e-6) and ensemble.beta_quantile(0.5, 3, 3) == pytest.approx(0.5)
    u, a, b = np.array([0.05, 0.5, 0.9, 0.999]), np.array([2.0, 3.0, 19.9, 0.5]), np.array([5.0, 3.0, 0.1, 12.0])
    assert ensemble.beta_quantiles(u, a, b) == pytest.approx([ensemble.beta_quantile(*x) for x in zip(u, a, b)], abs=1e-9)
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]])
    assert np.linalg.eigvalsh(ensemble.nearest_pd(bad)).min() > 0
    n = lambda k: spark.range(k).withColumnRenamed("id", "draw")
    paths = ["price.eta", "access.congestion.k", "price.phi_bull"]
    few, again = (ensemble.parameter_draws(n(k), P, paths, 1).orderBy("draw") for k in (3, 5))
    assert few.collect() == again.filter("draw < 3").collect() and all(0.5 <= r.price_eta <= 0.8 and r.price_phi_bull == 0.095 for r in again.collect())
    macro = ensemble.macro_draws(n(4000), 3).agg(F.corr("z_phi", "z_eta"), F.avg((F.col("macro") == "base").cast("double")), F.stddev("z_eta")).first()
    assert macro[0] == pytest.approx(-0.3, abs=0.05) and macro[1] == pytest.approx(0.6, abs=0.03) and macro[2] == pytest.approx(1, abs=0.05)
    shares = ensemble.mode_shares(n(5), P, 1)
    assert all(sum(v for k, v in r.asDict().items() if k != "draw") == pytest.approx(1) for r in shares.collect())
    projects = spark.createDataFrame([(1, "a", True, 0.5), (2, "a", True, 0.5), (3, "b", True, 0.5), (4, "c", False, 0.2), (5, None, False, 0.5)], "project_id long, announcer_id string, is_public boolean, p_completion double")
    many = ensemble.project_draws(projects, n(1500), 2)
    assert many.filter("draw = 7").orderBy("project_id").collect() == ensemble.project_draws(projects, n(9), 2).filter("draw = 7").orderBy("project_id").collect()
    wide = many.groupBy("draw").pivot("project_id", [1, 2, 3, 4, 5]).agg(F.first("p")).toPandas().corr()
    assert wide.loc["1", "2"] == pytest.approx(0.5, abs=0.08) and wide.loc["1", "3"] == pytest.approx(0.3, abs=0.08) and abs(wide.loc["1", "4"]) < 0.08
    assert many.filter("project_id = 4").agg(F.avg("p")).first()[0] == pytest.approx(0.2, abs=0.01)


def test_hedonic(spark):
    rng = np.random.default_rng(1)
    n = 400
    w = np.zeros((n, n))
    for i in range(n):
        for j in ((i + 1) % n, (i - 1) % n, (i + 20) % n, (i - 20) % n):
            w[i, j] = 0.25
    x = rng.normal(size=n)
    y = np.linalg.solve(np.eye(n) - 0.6 * w, 1 + 2 * x + 0.2 * rng.normal(size=n))
    df = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in range(n)], "cell long, x double, y double")
    weights = spark.createDataFrame([(i, j, 0.25) for i, j in zip(*(map(int, v) for v in np.nonzero(w)))], "cell long, other long, weight double")
    assert hedonic.choose(hedonic.lm_tests(df, weights, "cell", "other", "y", ["x"])) == "lag"
    fit = hedonic.fit_lag(df, weights, "cell", "other", "y", ["x"])
    assert fit["rho"] == pytest.approx(0.6, abs=0.08) and fit["x"] == pytest.approx(2, abs=0.1)
    # without a spatial process the statistics are those of dense algebra (a single draw may be significant by chance)
    z = 2 * x + rng.normal(size=n)
    noise = spark.createDataFrame([(i, float(x[i]), float(z[i])) for i in range(n)], "cell long, x double, y double")
    design = np.c_[np.ones(n), x]
    beta = np.linalg.lstsq(design, z, rcond=None)[0]
    e = z - design @ beta
    s2, trace, fit = e @ e / n, np.trace(w.T @ w + w @ w), w @ (design @ beta)
    spread = fit @ fit - fit @ design @ np.linalg.inv(design.T @ design) @ design.T @ fit
    got = hedonic.lm_tests(noise, weights, "cell", "other", "y", ["x"])
    assert got["lm_error"] == pytest.approx((e @ w @ e / s2) ** 2 / trace) and got["lm_lag"] == pytest.approx((e @ w @ z / s2) ** 2 / (spread / s2 + trace))
    shock = np.linalg.solve(np.eye(n) - 0.6 * w, rng.normal(size=n))
    errors = spark.createDataFrame([(i, float(x[i]), float(1 + 2 * x[i] + shock[i])) for i in range(n)], "cell long, x double, y double")
    fit = hedonic.fit_error(errors, weights, "cell", "other", "y", ["x"])
    assert fit["lambda"] == pytest.approx(0.6, abs=0.12) and fit["x"] == pytest.approx(2, abs=0.15) and fit["intercept"] == pytest.approx(1, abs=0.4)
    whole = hedonic.hedonic(errors, weights, "cell", "other", "y", ["x"])
    assert whole["model"] == "error" and whole["lambda"] == fit["lambda"] and hedonic.hedonic(df, weights, "cell", "other", "y", ["x"])["model"] == "lag"
    tests = {"p_lag": 0.5, "p_error": 0.5, "rlm_lag": 1.0, "rlm_error": 2.0}
    assert [hedonic.choose(tests | t) for t in ({}, {"p_lag": 0.01}, {"p_error": 0.01}, {"p_lag": 0.01, "p_error": 0.01})] == ["ols", "lag", "error", "error"]


def test_cascade(spark):
    cells = spark.createDataFrame([(i, 100.0 * i, 0.0, True, i != 2, 0.1 * i) for i in range(6)], "cell long, x_m double, y_m double, zoned boolean, powered boolean, score double")
    tiers = spark.createDataFrame([("plant", 1, 0.5, 0.8, 1.5, 250.0, "supplier"), ("supplier", 1, 0.1, 0.9, 1.0, 1000.0, "none")], cascade.TIERS)
    anchors = spark.createDataFrame([("p", "plant", 100.0, 0.9, 2030.0, 100.0, 0.0)], "id string, archetype string, jobs double, p double, open_year double, x double, y double")
    out = cascade.resolve(anchors, tiers, cells, 1000.0, 2, cut)
    first = out.filter("generation = 1").collect()
    assert {r.cell for r in first} == {0, 1, 3} and sum(r.jobs for r in first) == pytest.approx(50) and first[0].p == pytest.approx(0.72) and first[0].open_year == 2032
    reached = cells.withColumn("freight_access", F.col("cell") / 10.0)
    assert {r.cell for r in cascade.inject(anchors, tiers, reached, 1000.0, 0.1).collect()} == {3}
    with pytest.raises(ParamError):
        cascade.inject(anchors, tiers, reached, 1000.0)
    assert out.filter("generation = 2").agg(F.sum("jobs")).first()[0] == pytest.approx(5) and out.agg(F.max("generation")).first()[0] == 2


def test_ingest(spark):
    hexagon = [(100 * math.cos(math.radians(60 * i)), 100 * math.sin(math.radians(60 * i))) for i in range(6)]
    rng = np.random.default_rng(4)
    rings = [[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], [(500.0, 500.0), (600.0, 500.0), (600.0, 600.0)]]
    for _ in range(12):  # stars about a point, so rings that are not convex
        a, r = np.sort(rng.uniform(0, 2 * np.pi, 9)), rng.uniform(20, 180, 9)
        x, y = rng.uniform(-80, 80, 2)
        rings.append([(float(x + s * np.cos(t)), float(y + s * np.sin(t))) for t, s in zip(a, r)])
    df = spark.createDataFrame(list(enumerate(rings)), f"i long, ring {ingest.RING}")
    one_cell = spark.createDataFrame([(0, hexagon)], f"cell long, ring {ingest.RING}")
    shared = {r.i: r.area for r in ingest.overlay(one_cell, df, "cell", ["i"], 50.0).collect()}
    got = [shared.get(i, 0.0) for i in range(len(rings))]
    for ring, area in zip(rings, got):
        # the share of a fine grid of points that lie in both
        gx, gy = np.meshgrid(np.arange(-100, 100, 0.5) + 0.25, np.arange(-100, 100, 0.5) + 0.25)
        both = np.ones(gx.shape, bool)
        for poly in (ring, hexagon):
            odd = np.zeros(gx.shape, bool)
            for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
                if ay != by:
                    odd ^= ((ay > gy) != (by > gy)) & (gx < (bx - ax) * (gy - ay) / (by - ay) + ax)
            both &= odd
        assert area == pytest.approx(both.sum() * 0.25, abs=60)
    assert got[0] == pytest.approx(4.0) and (got[1] or 0.0) == 0
    grid = ingest.hex_grid(spark, 100.0, 1000.0, 1000.0)
    near = ingest.neighbours(grid).groupBy("cell").count().collect()
    assert max(r["count"] for r in near) == 6 and grid.select("cell").distinct().count() == grid.count()
    rows = [(i, [(float(x), float(y)) for x, y in ingest.hex_ring(q, r, 1000.0)]) for i, (q, r) in enumerate([(0, 0), (1, 0), (0, 1)])]
    cells = spark.createDataFrame(rows, f"cell long, ring {ingest.RING}")
    layer = spark.createDataFrame([("a", 2.0, [(-9000.0, -9000.0), (9000.0, -9000.0), (9000.0, 9000.0), (-9000.0, 9000.0)]), ("b", 1.0, [(0.0, -500.0), (500.0, -500.0), (500.0, 0.0), (0.0, 0.0)])], f"zone string, far double, ring {ingest.RING}")
    pieces = ingest.overlay(cells, layer, "cell", ["zone", "far"])
    full = 1.5 * math.sqrt(3) * 1e6
    area = {(r.cell, r.zone): r.area for r in pieces.collect()}
    assert all(area[i, "a"] == pytest.approx(full) for i in range(3)) and area[0, "b"] == pytest.approx(250000) and len(area) == 4
    points = spark.createDataFrame([(0.0, 0.0, "shop"), (10.0, 5.0, "shop"), (1732.0, 0.0, "school"), (1e6, 0.0, "shop")], "x double, y double, kind string")
    counts = {r.cell: (r.shop, r.school) for r in ingest.counts_in(points, cells, "cell", "kind", ["shop", "school"]).collect()}
    assert counts == {0: (2, 0), 1: (0, 1), 2: (0, 0)}
    roads = spark.createDataFrame([([(0.0, 0.0), (1000.0, 0.0)],)], f"line {ingest.RING}")
    spots = spark.createDataFrame([(1, 500.0, 30.0), (2, 1300.0, 400.0), (3, 9000.0, 0.0)], "cell long, x_m double, y_m double")
    assert {r.cell: r.dist_m for r in ingest.distance_to_lines(spots, roads, "cell", 2000.0).collect()} == {1: 30.0, 2: 500.0, 3: 2000.0}
    with pytest.raises(ValueError):
        ingest.merge(spots, spots.unionByName(spots), "cell")
    marked = ingest.mark_imputed(ingest.mark_imputed(spots, "x_m", F.col("cell") == 1, "first"), "x_m", F.col("cell") <= 2, "second")
    assert {r.cell: r["x_m__method"] for r in marked.collect()} == {1: "first", 2: "second", 3: None}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), {"announcers": ANNOUNCERS, "cells_history": CELLS_HISTORY})
    schema = "announcer_id string, name string, delivery_ratio double, median_slip_months double, mean_annual_capex_3y_inr_cr double"
    a = spark.createDataFrame([("x", "X", 0.5, None, 1.0), ("y", "Y", None, 2.0, None)], schema)
    store.write("announcers", a)
    with pytest.raises(SchemaError):
        store.write("announcers", a)
    store.write("announcers", spark.createDataFrame([("y", "Z", 1.0, 2.0, None), ("z", "Q", 1.0, 2.0, None)], schema), "upsert")
    assert sorted(r.name for r in store.read("announcers").collect()) == ["Q", "X", "Z"]
    assert store.read("announcers", announcer_id=["x", "q"]).count() == 1 and store.read("announcers", announcer_id=[]).count() == 0 and store.read("announcers", mean_annual_capex_3y_inr_cr=None).count() == 2
    with pytest.raises(KeyError):
        store.read("announcers", nothing=1)
    with pytest.raises(SchemaError):
        store.write("announcers", a.withColumn("extra", F.lit(1)), "replace")
    with pytest.raises(StoreError):
        store.write("elsewhere", a)
    said = store.snapshot(str(tmp_path / "snap"), ("announcers",), P.hash())
    assert open_snapshot(spark, str(tmp_path / "snap"), said)["announcers"].count() == 3
    a.write.mode("append").parquet(str(tmp_path / "snap" / "announcers"))
    with pytest.raises(StoreError):
        open_snapshot(spark, str(tmp_path / "snap"), said)


def test_content_hash(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2, "x"), (2, float("nan"), None)], "k long, v double, s string")
    assert content_hash(a) == content_hash(a.repartition(3).orderBy(F.desc("k")).select("s", "v", "k")) == content_hash(spark.createDataFrame([(1, 0.3, "x"), (2, None, None)], "k long, v double, s string"))
    assert content_hash(a) != content_hash(a.unionByName(a)) and content_hash(a) != content_hash(a.withColumn("s", F.lit("x")))


def test_readers(spark, tmp_path):
    (tmp_path / "g.csv").write_text("locality_id,guidance_inr_sqyd\na,90\n")
    reader = FileReader(spark, str(tmp_path), {"g.csv": "locality_id string, guidance_inr_sqyd double"})
    got = adapter_for("AP").guidance(reader.table("g.csv")).first()
    assert got.guidance_inr_sqft == 10 and got.sro_code is None and reader.exists("g.csv") and not reader.exists("h.csv")
    assert MemoryReader({"t": spark.range(2)}).table("t").count() == 2
    with pytest.raises(ParamError):
        adapter_for("XX")


def test_guards(spark):
    df = spark.createDataFrame([(2019, "2020-05-01")], "year long, d string").withColumn("d", F.to_date("d"))
    assert govern.no_lookahead(df, 2020, "year", "d").count() == 1
    with pytest.raises(govern.GuardError):
        govern.no_lookahead(df, 2019, "year", "d")
    with pytest.raises(govern.GuardError):
        govern.exposable(df.select(F.struct(F.lit(1).alias("ask_price")).alias("s")))
    with pytest.raises(govern.GuardError):
        govern.vintage_ok({"a": 2018, "b": None}, 2020, 5)
    data = {"price": {"growth": [3.2, 4.0]}}
    assert govern.unverified("Prices grew 4.0 % [price.growth.1] then.", data) == [] and govern.unverified("by 9 [price.growth.0] and [price.none]", data) == ["price.growth.0", "price.none"]
    assert "4.0 % then." in govern.render_report("T", [("S", "Prices grew 4.0 % [price.growth.1] then.")], data, {"hash": "x"})
    with pytest.raises(govern.GuardError):
        govern.render_report("T", [("S", "9 [price.growth.1]")], data, {})
    used, known = spark.createDataFrame([("a",), ("b",), ("c",)], "source string"), spark.createDataFrame([("a", "open"), ("b", "closed")], "source string, class string")
    assert {(r.source, r.problem) for r in govern.licence_audit(used, known, ("open",)).collect()} == {("b", "closed"), ("c", "undeclared")}


def test_simulation(spark):
    cells = substrate.substrate(view(spark, SF, "a_cells"), P).filter("cell < 60")
    projects = view(spark, SF, "a_projects").filter("cell < 60 AND project_id % 40 = 0").withColumn("p_completion", F.lit(0.6))
    ids = sorted(r.project_id for r in projects.select("project_id").collect())
    years = simulation.horizon(2000, 2002)
    full, none = simulation.Scenario("full", years), simulation.Scenario("base", years, tuple(ids))
    out = simulation.run(cells, projects, [full, none], P)
    assert out.panel.count() == 2 * 3 * cells.count()
    again = simulation.run(cells.repartition(3), projects, [full, none], P)
    assert simulation.digest(out.panel) == simulation.digest(again.panel) and out.manifest == again.manifest
    assert simulation.run_digest(out) == simulation.run_digest(again) != simulation.run_digest(out, cells)
    alone = simulation.run(cells, projects, [full], P)
    assert simulation.digest(alone.panel) == simulation.digest(out.panel.filter("scenario = 'full'"))
    parts = simulation.decompose(cells, projects, {"a": tuple(ids[::2]), "b": tuple(ids[1::2])}, years, P)
    row = parts.agg(F.max(F.abs(F.col("total") - F.col("lambda_a") - F.col("lambda_b"))).alias("off"), F.max("total").alias("top")).first()
    assert row.top > 0
    draws = spark.createDataFrame([(0, 1.0), (1, 1.5)], "draw long, gamma_mult double")
    many = simulation.run(cells, projects, [full], P, draws).panel
    assert simulation.digest(many.filter("draw = 0")) == simulation.digest(alone.panel)
    forced = simulation.run(cells, projects, [full, simulation.Scenario("forced", years, (), tuple((i, 1.0) for i in ids))], P).panel
    by = {r.scenario: r.f for r in forced.groupBy("scenario").agg(F.sum("field").alias("f")).collect()}
    assert by["forced"] == pytest.approx(by["full"] / 0.6)
    moved = {y: cells.select("cell", (F.col("lna") + (0.5 if y == 2001 else 0.0)).alias("lna")) for y in years}
    up = simulation.run(cells, projects, [full], P, access=moved).panel
    at = lambda panel, y: panel.filter(F.col("year") == y).agg(F.avg("d_ln_p")).first()[0]
    assert at(up, 2000) == pytest.approx(at(alone.panel, 2000)) and at(up, 2001) > at(alone.panel, 2001) + 0.01 and at(up, 2002) < at(alone.panel, 2002)
    drawn = simulation.ensemble(cells, projects, full, P, 4, 11)
    assert drawn.panel.count() == 4 * 3 * cells.count() and drawn.manifest["runs"] == 4
    assert simulation.digest(drawn.panel.filter("draw < 2")) == simulation.digest(simulation.ensemble(cells, projects, full, P, 2, 11).panel)
    assert drawn.panel.groupBy("draw").agg(F.avg("d_ln_p").alias("d")).select("d").distinct().count() == 4
    with pytest.raises(simulation.SimulationError):
        simulation.horizon(2000, 2100)
    states = spark.createDataFrame([(2000, "a"), (2001, "b")], "year long, state string")
    assert set(simulation.network_years(states, {"a": cells, "b": cells}, (2000, 2001))) == {2000, 2001}
    with pytest.raises(simulation.SimulationError):
        simulation.network_years(states, {"a": cells}, (2000, 2001))


def test_streams(spark, tmp_path):
    from terrane.streaming.monitor import composite_stream, ratchet_stream

    events = view(spark, SF, "a_events").filter("project < 20")
    source = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)

    def drained(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    batch = measures.ratchet(events, "project", ["ts", "event_id"], "state_rank").filter("ratcheted IS NOT NULL")
    assert sorted((r.event_id, r.ratcheted) for r in drained(ratchet_stream(stream), "append", "ratchets").collect()) == sorted((r.event_id, r.ratcheted) for r in batch.collect())
    got = drained(composite_stream(stream), "complete", "composites")
    assert got.agg(F.sum("n")).first()[0] == events.filter("clear").count()


def test_plans_stay_narrow(spark):
    """A two-column query reads two columns, and its filter reaches the scan."""
    df = measures.read_where(table(spark, SF, "lineitem"), l_partkey=[1, 2]).select("l_partkey", "l_quantity")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(l_partkey" in plan and "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan
