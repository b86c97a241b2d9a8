"""Queries of joins in time, sessions, shortest paths, sensitivity, spatial tests and snapshots, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import scalar as sc
from terrane.operators import access, cascade, credibility as cr, govern, hedonic, networks, sensitivity, substrate as sub, timejoin
from terrane.plans import backtest
from terrane.plans.backtest import PRIME
from terrane.plans.catalogue import BETAS, KMH, KNN, OD, OPP, P, SHARE as MODE_SHARE, SHARES, TIE, WEIGHTS, _knn, add
from terrane.plans.catalogue_shapes import districts
from terrane.schema import SECTORS
from terrane.sources import snapshot_tree
from terrane.streaming import monitor

c = F.col
HOURS = 6

# --- time ------------------------------------------------------------------------------------------------------
add("events_as_of", "events", """SELECT e.event_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type <> 'view') e
  ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON v.user_id = e.user_id AND v.ts <= e.ts""",
    lambda e: timejoin.as_of(e.filter("event_type <> 'view'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", "ts", c("event_id").alias("view_id"), c("value").alias("view_value")), "user_id", "ts", "ts", "view_id", ["view_id", "view_value"])
    .select("event_id", "view_id", "view_value"))
add("events_in_intervals", "events", f"SELECT e.event_id, s.event_id AS opened_by FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL {HOURS} HOUR",
    lambda e: timejoin.in_intervals(e.select("event_id", "user_id", "ts"), e.filter("event_type = 'signup'").select("user_id", c("ts").alias("from"), (c("ts") + F.expr(f"INTERVAL {HOURS} HOURS")).alias("to"), c("event_id").alias("opened_by")), "user_id", "ts", "from", "to", ["opened_by"])
    .select("event_id", "opened_by"))
add("event_sessions", "a_events", f"""WITH m AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL {HOURS} HOUR, TRUE) AS new FROM a_events WINDOW w AS (PARTITION BY project ORDER BY ts, event_id)), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY project ORDER BY ts, event_id) AS k FROM m)
  SELECT project, epoch_us(min(ts)) AS "start", epoch_us(max(ts)) + {HOURS} * 3600000000 AS "end", count(*) AS n, round(sum(value), 6) AS value, max(state_rank) AS top FROM s GROUP BY project, k""",
    lambda e: monitor.sessions(e, f"{HOURS} hours").withColumns({n: F.unix_micros(n) for n in ("start", "end")}))

# --- networks --------------------------------------------------------------------------------------------------
STATIONS = "st AS (SELECT CAST(s_nationkey AS VARCHAR) AS line, CAST(s_suppkey % 37 AS VARCHAR) AS station, min(s_suppkey) AS place, (s_suppkey % 37) * 700e0 AS x, (s_suppkey % 37 * 17 % 29) * 600e0 AS y FROM supplier GROUP BY s_nationkey, s_suppkey % 37)"
HAUL, DWELL, TRANSFER = P.value("access.speeds_kmh")["metro_line_haul"], P.value("access.rail.dwell_min"), P.value("access.rail.transfer_min")


def _stations(s: DataFrame) -> DataFrame:
    k = c("s_suppkey") % 37
    rows = s.groupBy(c("s_nationkey").cast("string").alias("line"), k.alias("k")).agg(F.min("s_suppkey").alias("place"))
    return rows.select("line", c("k").cast("string").alias("station"), "place", (c("k") * 700.0).alias("x"), (c("k") * 17 % 29 * 600.0).alias("y"))


add("rail_shortest", "supplier", f"""WITH RECURSIVE {STATIONS}, n AS (SELECT *, line || '|' || station AS u FROM st),
  one AS (SELECT u, lead(u) OVER w AS v, sqrt(pow(x - lead(x) OVER w, 2) + pow(y - lead(y) OVER w, 2)) / 1000 / {HAUL} * 60 + {DWELL} AS m FROM n WINDOW w AS (PARTITION BY line ORDER BY place, station)
    UNION ALL SELECT u, lead(u) OVER (PARTITION BY station ORDER BY line), {TRANSFER} FROM n),
  e AS (SELECT u, v, m::DOUBLE AS m FROM one WHERE v IS NOT NULL UNION ALL SELECT v, u, m FROM one WHERE v IS NOT NULL),
  ways(u, v, d) USING KEY (u, v) AS (SELECT u, u, 0e0 FROM (SELECT u FROM e UNION SELECT v FROM e)
    UNION SELECT w.u, e.v, min(w.d + e.m) FROM ways w JOIN e ON e.u = w.v LEFT JOIN recurring.ways r ON r.u = w.u AND r.v = e.v WHERE w.d + e.m < coalesce(r.d, 1e18) - 1e-9 GROUP BY w.u, e.v)
  SELECT u AS board, v AS alight, round(d + 1e-9, 6) AS ride FROM ways""", lambda s: networks.rail_minutes(_stations(s), P).withColumn("ride", c("ride") + 1e-9))

# --- jobs of wards ---------------------------------------------------------------------------------------------
GROWN = {"it_office": 1.6, "logistics": 1.25}
WARD_JOBS = {"it_office": 3, "retail_svc": 5, "logistics": 7}
add("l0_ward_jobs", "a_cells", f"""WITH s(sector, k, growth) AS (VALUES {', '.join(f"('{s}', {k}, {GROWN.get(s, 1.0)}e0)" for s, k in WARD_JOBS.items())}),
  w AS (SELECT DISTINCT zone, sector, (zone % k + 1) * 40e0 * growth AS jobs FROM a_cells, s WHERE zone % 6 <> 0 AND zone % k <> 1),
  g AS (SELECT cell, zone, sector, CASE sector WHEN 'retail_svc' THEN com_sqm * retail_poi ELSE com_sqm END AS w FROM a_cells, s), t AS (SELECT zone, sector, sum(w) AS t, count(*) AS n FROM g GROUP BY ALL)
  SELECT cell, sector, round(jobs * CASE WHEN t > 0 THEN g.w / t ELSE 1e0 / n END, 6) AS jobs FROM g JOIN t USING (zone, sector) JOIN w USING (zone, sector) WHERE jobs * CASE WHEN t > 0 THEN g.w / t ELSE 1e0 / n END > 0""", lambda x: _ward_jobs(x))


def _ward_jobs(x: DataFrame) -> DataFrame:
    sectors = F.explode(F.array(*[F.struct(F.lit(s).alias("sector"), F.lit(k).alias("k")) for s, k in WARD_JOBS.items()])).alias("s")
    wards = x.select("zone").distinct().select("zone", sectors).filter("zone % 6 <> 0 AND zone % s.k <> 1").select("zone", "s.sector", ((c("zone") % c("s.k") + 1) * 40.0).alias("jobs"))
    found = sub.assemble(x, P, wards, GROWN, {"retail_svc": "retail_poi"}, "zone")
    return found.select("cell", F.posexplode("jobs_by_sector").alias("i", "jobs")).filter("jobs > 0").select("cell", F.element_at(F.array(*[F.lit(s) for s in SECTORS]), c("i") + 1).alias("sector"), "jobs")


# --- accessibility, as one table -------------------------------------------------------------------------------
LIMITS = [5, 10, 20]
add("l1_layer", "a_cells", f"""WITH {OD}, {OPP}, city AS (SELECT * FROM a_cells WHERE zone % 5 <> 0), chosen AS (SELECT cell FROM city WHERE households * 4 > 0 OR absorbed - 1500 > 0),
  g AS (SELECT cell, {', '.join(f"ln(1 + sum({MODE_SHARE} * exp(-minutes * CASE mode {' '.join(f'WHEN {m!r} THEN {b}e0' for m, b in BETAS[x].items())} END) * o_{x})) AS lna_{x}" for x in BETAS)},
    {', '.join(f'sum(CASE WHEN minutes <= {t} THEN {MODE_SHARE} * o_work ELSE 0 END) AS jobs_{t}' for t in LIMITS)} FROM od JOIN opp USING (zone) WHERE cell IN (SELECT cell FROM chosen) GROUP BY cell),
  st AS (SELECT x_m AS sx, y_m AS sy, cell % 2 = 0 AS feeder FROM a_cells WHERE brand = 'Brand#13'),
  w AS (SELECT a.cell, max(CASE WHEN d <= 400 THEN 1e0 WHEN d <= 800 THEN 0.6e0 WHEN d <= 1200 THEN 0.3e0 WHEN d <= 1600 THEN 0.12e0 WHEN d <= 6000 AND feeder THEN 0.15e0 ELSE 0e0 END) AS station_weight
    FROM (SELECT a.cell, feeder, sqrt(pow(x_m - sx, 2) + pow(y_m - sy, 2)) AS d FROM a_cells a, st) a GROUP BY a.cell)
  SELECT a.cell, {', '.join(f'round(lna_{x}, 6) AS lna_{x}' for x in BETAS)}, round({' + '.join(f'{w}e0 * lna_{x}' for x, w in WEIGHTS.items())}, 6) AS lna, {', '.join(f'round(jobs_{t}, 6) AS jobs_{t}' for t in LIMITS)}, coalesce(station_weight, 0) AS station_weight
  FROM a_cells a LEFT JOIN g ON g.cell = a.cell LEFT JOIN w ON w.cell = a.cell""", lambda x: _layer(x))


def _layer(x: DataFrame) -> DataFrame:
    stations = x.filter("brand = 'Brand#13'").select(c("cell").alias("station"), c("x_m").alias("sx"), c("y_m").alias("sy"), (c("cell") % 2 == 0).alias("feeder"))
    cells = x.drop("lna").withColumn("in_city", c("zone") % 5 != 0).withColumn("population", c("households") * 4).withColumn("headroom_sqm", c("absorbed") - 1500)
    return access.layer(cells, "cell", "zone", stations, KMH, SHARES, BETAS, WEIGHTS, LIMITS, P)


# --- elasticity ------------------------------------------------------------------------------------------------
def _regressed() -> str:
    """SQL of least squares on four terms: each term less its fit on those before it, then coefficients from the last."""
    steps, prior = [], []
    for k in range(1, 5):
        rest = " - ".join([f"x{k} - avg(x{k}) OVER ()"] + [f"(covar_pop(x{k}, u{j}) OVER () / var_pop(u{j}) OVER ()) * u{j}" for j in prior])
        steps.append(f"o{k} AS (SELECT *, {rest} AS u{k} FROM {'d' if k == 1 else f'o{k - 1}'})")
        prior.append(k)
    left = "y"
    for k in (4, 3, 2, 1):
        steps.append(f"c{k} AS (SELECT *, covar_pop({left}, u{k}) OVER () / var_pop(u{k}) OVER () AS b{k} FROM {f'o4' if k == 4 else f'c{k + 1}'})")
        left = f"{left} - b{k} * x{k}"
    return ", ".join(steps)


add("elasticity_fit", "a_cells", f"""WITH z AS (SELECT (cell % 17 - 3) / 40e0 AS dp, (cell % 17 - 3) / 40e0 * (CASE WHEN cell % 31 = 0 THEN -1 ELSE 1 END) * (0.2e0 + (cell % 23) / 20e0) AS dq, * FROM a_cells),
  d AS (SELECT ln(dq / dp) AS y, ln(1 - coalesce(undevelopable_frac, 0) + 0.01e0) AS x1, amenity AS x2, ln(1 - builtup_frac + 0.01e0) AS x3, ln(mean_parcel_sqm) AS x4 FROM z WHERE abs(dp) >= 0.05 AND dq / dp > 0 AND mean_parcel_sqm > 0), {_regressed()}
  SELECT round(avg(y - b1 * x1 - b2 * x2 - b3 * x3 - b4 * x4), 5) AS intercept, round(any_value(b1), 5) AS open_land, round(any_value(b2), 5) AS regulation, round(any_value(b3), 5) AS unbuilt, round(any_value(b4), 5) AS parcel,
    round(var_pop(b1 * x1 + b2 * x2 + b3 * x3 + b4 * x4) / var_pop(y), 5) AS r2, count(*) AS n FROM c1""", lambda x: _elasticity(x))


def _elasticity(x: DataFrame) -> DataFrame:
    moved = (c("cell") % 17 - 3) / 40.0
    zones = x.fillna(0.0, ["undevelopable_frac"]).withColumn("regulatory_index", c("amenity")).withColumn("dln_price", moved)
    got = sub.fit_elasticity(zones.withColumn("dln_floorspace", moved * F.when(c("cell") % 31 == 0, -1).otherwise(1) * (0.2 + c("cell") % 23 / 20.0)), 0.05)
    names = {"intercept": "intercept", "_open": "open_land", "regulatory_index": "regulation", "_unbuilt": "unbuilt", "_parcel": "parcel", "r2": "r2"}
    return x.sparkSession.createDataFrame([(*[round(float(got[k]), 5) for k in names], int(got["n"]))], ", ".join(f"{v} double" for v in names.values()) + ", n long")


# --- cascades --------------------------------------------------------------------------------------------------
TIERS = [("it_office", 1, 0.4, 0.8, 1.0, 900.0, "retail_svc"), ("manuf_light", 1, 0.5, 0.75, 1.5, 800.0, "logistics"), ("manuf_light", 2, 0.2, 0.5, 2.5, 1000.0, "retail_svc"), ("logistics", 1, 0.1, 0.9, 0.5, 600.0, "retail_svc")]


def _anchors(j: DataFrame, x: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    anchors = j.join(x.select("cell", "x_m", "y_m"), "cell").select(c("project_id").alias("id"), c("sector").alias("archetype"), c("x_m").alias("x"), c("y_m").alias("y"), "jobs", (c("wage") / 200_000).alias("p"), (c("start_year") + 0.25).alias("open_year"))
    cells = x.select("cell", "x_m", "y_m", (c("zone") % 5 != 0).alias("zoned"), (c("util_power") == 1).alias("powered"), c("lna").alias("score"), c("amenity").alias("freight_access"))
    return anchors, x.sparkSession.createDataFrame(TIERS, cascade.TIERS), cells


add("cascade_injection", "a_jobs a_cells", f"""WITH t(archetype, tier, jobs_ratio, p_mult, lag_years, radius_m, follows) AS (VALUES {', '.join(f"('{a}', {b}, {d}e0, {e}e0, {f}e0, {g}e0, '{h}')" for a, b, d, e, f, g, h in TIERS)}),
  a AS (SELECT project_id AS id, sector AS archetype, x_m AS x, y_m AS y, a_jobs.jobs, wage / 200000 AS p, start_year + 0.25e0 AS open_year FROM a_jobs JOIN a_cells USING (cell)),
  n AS (SELECT a.*, t.* EXCLUDE (archetype), k.cell, k.lna, k.x_m, k.y_m FROM a JOIN t USING (archetype) JOIN a_cells k ON k.x_m BETWEEN a.x - radius_m AND a.x + radius_m AND k.y_m BETWEEN a.y - radius_m AND a.y + radius_m
    WHERE k.zone % 5 <> 0 AND k.util_power = 1 AND k.amenity > 0.2 AND sqrt(pow(k.x_m - a.x, 2) + pow(k.y_m - a.y, 2)) <= least(radius_m, 1000)),
  e AS (SELECT *, exp(lna) / sum(exp(lna)) OVER (PARTITION BY id, tier) AS share FROM n)
  SELECT id, tier::BIGINT AS tier, cell, follows AS archetype, round(jobs * jobs_ratio * share + 1e-9, 6) AS jobs, round(p * p_mult + 1e-9, 6) AS p, round_even(open_year + lag_years, 0) AS open_year FROM e""",
    lambda j, x: _injected(j, x))


def _injected(j: DataFrame, x: DataFrame) -> DataFrame:
    anchors, tiers, cells = _anchors(j, x)
    return cascade.inject(anchors, tiers, cells, 1000.0, 0.2).select("id", "tier", "cell", "archetype", (c("jobs") + TIE).alias("jobs"), (c("p") + TIE).alias("p"), "open_year")


# --- slips and sources -----------------------------------------------------------------------------------------
FAMILIES = P.value("credibility.delay_families")
LAW = "CASE WHEN z < -8 THEN 0 WHEN z > 8 THEN 1 ELSE 0.5e0 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: pow(z, 2 * k + 1) * sqrt(pi()) / exp((k + 1) * ln(2) + lgamma(k + 1.5e0)))) END"


def _cdf_sql() -> str:
    value = lambda f, k: f"{float(f[k])}e0" if k in f else "NULL"
    rows = ", ".join(f"('{k}', {', '.join(value(f, x) for x in ('median', 'fast_p', 'fast_slip', 'slow_slip', 'sigma'))})" for k, f in FAMILIES.items())
    return f"""WITH fam(name, median, fast_p, fast_slip, slow_slip, sigma) AS (VALUES {rows}),
      x AS (SELECT name, fam.* EXCLUDE (name), s_suppkey AS point, (s_suppkey % 97) / 20e0 AS x FROM fam, supplier), z AS (SELECT *, CASE WHEN x > 0 THEN (ln(x) - ln(coalesce(median, slow_slip))) / sigma END AS z FROM x),
      l AS (SELECT *, CASE WHEN x > 0 THEN {LAW} ELSE 0 END AS law FROM z)
      SELECT name AS family, point, round(least(1, greatest(0, CASE WHEN fast_p IS NULL THEN law ELSE (1 - fast_p) * law + CASE WHEN x >= fast_slip THEN fast_p ELSE 0 END END)) + 1e-9, 6) AS share FROM l"""


add("slip_cdf", "supplier", _cdf_sql(), lambda s: _slips(s))


def _slips(s: DataFrame) -> DataFrame:
    """Of each delay family, the share of slips up to each of the points that suppliers stand for."""
    points = s.select(c("s_suppkey").alias("point"), (c("s_suppkey") % 97 / 20.0).alias("x"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), (cr.slip_cdf(f, c("x")) + TIE).alias("share")) for k, f in FAMILIES.items()]))
    return points.select("point", each.alias("_e")).select("_e.family", "point", "_e.share")


add("source_licences", "part supplier", """SELECT DISTINCT p_brand || ':' || p_size AS source, CASE WHEN class IS NULL THEN 'undeclared' ELSE class END AS problem FROM part
  LEFT JOIN (SELECT DISTINCT 'Brand#' || (s_suppkey % 25 + 1) || ':' || (s_suppkey % 50 + 1) AS source, CASE s_suppkey % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'amber' ELSE 'red' END AS class FROM supplier) r ON r.source = p_brand || ':' || p_size WHERE class IS NULL OR class = 'red'""",
    lambda x, s: govern.licence_audit(x.select(F.concat_ws(":", "p_brand", "p_size").alias("source")).distinct(), s.select(F.concat(F.lit("Brand#"), c("s_suppkey") % 25 + 1, F.lit(":"), c("s_suppkey") % 50 + 1).alias("source"),
                                      F.when(c("s_suppkey") % 3 == 0, "green").when(c("s_suppkey") % 3 == 1, "amber").otherwise("red").alias("class")).distinct(), ("green", "amber")).distinct())
add("district_areas", "a_districts", "SELECT zone_id, round(wide * high - (rx1 - rx0) * (ry1 - ry0), 4) AS area, round(CASE WHEN form = 2 THEN wide * high - (rx1 - rx0) * (ry1 - ry0) ELSE wide * high END, 4) AS outer_area FROM a_districts",
    lambda d: districts(d).select("zone_id", F.round(F.aggregate(F.transform("rings", lambda r, i: F.when(i == 0, sc.ring_area(r)).otherwise(-sc.ring_area(r))), F.lit(0.0), lambda a, v: a + v), 4).alias("area"), F.round(sc.ring_area(F.get("rings", F.lit(0))), 4).alias("outer_area")))

# --- sensitivity -----------------------------------------------------------------------------------------------
PARAMETERS = ["gamma", "eta", "share"]


def _sobol_sql(index: str, dimension: int) -> str:
    gray = f"xor({index}, {index} // 2)"
    said = "0::BIGINT"
    for i, v in enumerate(sensitivity.directions(dimension)):
        said = f"xor({said}, (({gray}) // {1 << i} % 2) * {v}::BIGINT)"
    return f"({said}) / 4294967296e0"


add("sobol_points", "part", "SELECT p_partkey AS draw, " + ", ".join(f"round({_sobol_sql('p_partkey', d)} + 1e-9, 6) AS x{d}" for d in (1, 2, 5, 10)) + " FROM part", lambda x: x.select(c("p_partkey").alias("draw"), *[(sensitivity.sobol(c("p_partkey"), d) + TIE).alias(f"x{d}") for d in (1, 2, 5, 10)]))
add("sobol_indices", "part", "WITH p AS (SELECT p_partkey AS i, " + ", ".join(f"{_sobol_sql('p_partkey', d)} AS x{d}" for d in range(1, 7)) + """ FROM part),
  f AS (SELECT i, x1 + 2 * x2 + 3 * x1 * x3 AS a, x4 + 2 * x5 + 3 * x4 * x6 AS b, x4 + 2 * x2 + 3 * x4 * x3 AS s1, x1 + 2 * x5 + 3 * x1 * x3 AS s2, x1 + 2 * x2 + 3 * x1 * x6 AS s3 FROM p),
  v AS (SELECT (var_pop(a) + var_pop(b)) / 2 AS v, count(*) AS n, avg(b * (s1 - a)) AS f1, avg(b * (s2 - a)) AS f2, avg(b * (s3 - a)) AS f3, avg((a - s1) ** 2) / 2 AS t1, avg((a - s2) ** 2) / 2 AS t2, avg((a - s3) ** 2) / 2 AS t3 FROM f)
  SELECT 'gamma' AS parameter, round(f1 / v, 6) AS first_order, round(t1 / v, 6) AS total, n FROM v UNION ALL SELECT 'eta', round(f2 / v, 6), round(t2 / v, 6), n FROM v UNION ALL SELECT 'share', round(f3 / v, 6), round(t3 / v, 6), n FROM v""",
    lambda x: sensitivity.indices(sensitivity.design(x, "p_partkey", PARAMETERS).withColumn("f", c("gamma") + 2 * c("eta") + 3 * c("gamma") * c("share")), "p_partkey", "f", PARAMETERS))

REPLICATES, SEED = 40, 20240607

# --- spatial tests ---------------------------------------------------------------------------------------------
LINEAR = f"""{KNN}, o AS (SELECT cell, amenity + lna / 10 AS y, disamenity AS x FROM a_cells), g AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM o),
  b AS (SELECT *, n * sxx - sx * sx AS det, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, (sy * sxx - sx * sxy) / (n * sxx - sx * sx) AS b0 FROM g),
  r AS (SELECT cell, x, y, b0 + b1 * x AS f, y - b0 - b1 * x AS e FROM o, b),
  l AS (SELECT w.cell, sum(weight * e) AS we, sum(weight * y) AS wy, sum(weight * f) AS wf, sum(weight * x) AS wx, sum(weight) AS w1 FROM w JOIN r ON r.cell = w.other GROUP BY w.cell)"""
add("hedonic_tests", "a_cells", f"""WITH {LINEAR}, s AS (SELECT sum(e * e) / count(*) AS s2, sum(e * we) AS ewe, sum(e * wy) AS ewy, sum(wf * wf) AS ff, sum(wf) AS f1, sum(wf * x) AS fx FROM r JOIN l USING (cell)),
  t AS (SELECT sum(w.weight * w.weight + w.weight * coalesce(v.weight, 0)) AS t FROM w LEFT JOIN w v ON v.cell = w.other AND v.other = w.cell),
  q AS (SELECT s2, t, ewe / s2 AS de, ewy / s2 AS dl, (ff - (f1 * f1 * sxx - 2 * f1 * fx * sx + fx * fx * n) / det) / s2 AS sp FROM s, t, b)
  SELECT round(de * de / t, 6) AS lm_error, round(dl * dl / (sp + t), 6) AS lm_lag, round((dl - de) * (dl - de) / sp, 6) AS rlm_lag, round(pow(de - t / (sp + t) * dl, 2) / (t * (1 - t / (sp + t))), 6) AS rlm_error FROM q""",
    lambda x: _tests(x))

add("hedonic_lag", "a_cells", f"""WITH {LINEAR}, c AS (SELECT covar_pop(wx, x) / var_pop(x) AS g FROM r JOIN l USING (cell)), v AS (SELECT r.*, l.*, wx - g * x AS z FROM r JOIN l USING (cell), c),
  s AS (SELECT covar_pop(z, y) / covar_pop(z, wy) AS rho, covar_pop(x, y) AS xy, covar_pop(x, wy) AS xw, var_pop(x) AS xx, avg(y) AS my, avg(wy) AS mw, avg(x) AS mx FROM v), b2 AS (SELECT *, (xy - rho * xw) / xx AS b1 FROM s)
  SELECT round(rho, 5) AS rho, round(my - rho * mw - b1 * mx, 5) AS intercept, round(b1, 5) AS x, round(b1 / (1 - rho), 5) AS total_x FROM b2""", lambda x: _lag(x))
add("bt_rank_bootstrap", "a_cells", f"""WITH z AS (SELECT zone, avg(lna) AS p, avg(amenity) AS q, avg(raw_price) AS t, row_number() OVER (ORDER BY zone) AS k, count(*) OVER () AS n FROM a_cells GROUP BY zone),
  x0 AS (SELECT i, j, n, ({SEED} % {PRIME} + i * 69621 + j * 48271) % {PRIME} AS x FROM range({REPLICATES}) a(i), (SELECT k - 1 AS j, n FROM z)), x1 AS (SELECT i, j, n, (((x * x + 12345 + i) % {PRIME}) * 16807 + j) % {PRIME} AS x FROM x0),
  d AS (SELECT i, p, q, t FROM (SELECT i, ((x * x + 67891) % {PRIME}) % n + 1 AS k FROM x1) JOIN z USING (k)),
  r AS (SELECT i, rank() OVER (PARTITION BY i ORDER BY p) + (count(*) OVER (PARTITION BY i, p) - 1) / 2 AS p, rank() OVER (PARTITION BY i ORDER BY q) + (count(*) OVER (PARTITION BY i, q) - 1) / 2 AS q, rank() OVER (PARTITION BY i ORDER BY t) + (count(*) OVER (PARTITION BY i, t) - 1) / 2 AS t FROM d)
  SELECT i::BIGINT AS replicate, round(corr(p, t) - corr(q, t), 6) AS difference FROM r GROUP BY i""",
    lambda x: backtest.bootstrap_rank_difference(x.groupBy("zone").agg(F.avg("lna").alias("p"), F.avg("amenity").alias("q"), F.avg("raw_price").alias("t")), "p", "q", "t", REPLICATES, SEED))


def _lag(x: DataFrame) -> DataFrame:
    rows = x.select("cell", (c("amenity") + c("lna") / 10).alias("y"), c("disamenity").alias("x"))
    got = hedonic.fit_lag(rows, _knn(x), "cell", "other", "y", ["x"])
    return x.sparkSession.createDataFrame([tuple(round(float(got[k]), 5) for k in ("rho", "intercept", "x", "total_x"))], "rho double, intercept double, x double, total_x double")


def _tests(x: DataFrame) -> DataFrame:
    rows = x.select("cell", (c("amenity") + c("lna") / 10).alias("y"), c("disamenity").alias("x"))
    got = hedonic.lm_tests(rows, _knn(x), "cell", "other", "y", ["x"])
    return x.sparkSession.createDataFrame([tuple(float(got[k]) for k in ("lm_error", "lm_lag", "rlm_lag", "rlm_error"))], "lm_error double, lm_lag double, rlm_lag double, rlm_error double")


# --- snapshots -------------------------------------------------------------------------------------------------
SPAN, FAN = 256, 8
add("snapshot_tree", "orders", f"""WITH h AS (SELECT o_orderkey AS k, sha256('o_custkey:bigint=' || length(o_custkey::VARCHAR) || ':' || o_custkey || ';o_orderdate:timestamp=' || length(epoch_us(o_orderdate)::VARCHAR) || ':' || epoch_us(o_orderdate)
    || ';o_orderkey:bigint=' || length(o_orderkey::VARCHAR) || ':' || o_orderkey || ';o_orderstatus:string=' || length(o_orderstatus) || ':' || o_orderstatus) AS h FROM orders),
  l0 AS (SELECT k // {SPAN} AS node, count(*) AS n, sha256(string_agg(h, ',' ORDER BY k, h)) AS hash FROM h GROUP BY ALL),
  l1 AS (SELECT node // {FAN} AS node, sum(n) AS n, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM l0 GROUP BY node // {FAN}),
  l2 AS (SELECT node // {FAN} AS node, sum(n) AS n, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM l1 GROUP BY node // {FAN})
  SELECT 0 AS level, node, n, hash FROM l0 UNION ALL SELECT 1, node, n::BIGINT, hash FROM l1 UNION ALL SELECT 2, node, n::BIGINT, hash FROM l2""",
    lambda o: snapshot_tree.tree(o.select("o_custkey", c("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderkey", "o_orderstatus"), "o_orderkey", SPAN, FAN, 2))
