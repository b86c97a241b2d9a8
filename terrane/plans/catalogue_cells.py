"""Queries of the operators that make columns of cells, of detection, and of the gate, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import cell_columns as cc, detection, govern, ingest, measures as ms, substrate as sub
from terrane.plans import ledger, scorecard
from terrane.plans.backtest import PRIME
from terrane.plans.catalogue import P, TIE, add

c = F.col

# --- buildings, zoning, utilities ------------------------------------------------------------------------------
add("cells_populated", "a_cells", "SELECT cell FROM a_cells WHERE zone % 5 <> 0 AND (households * 4 >= 1 OR builtup_frac > 0)",
    lambda x: cc.populated(x.withColumn("in_city", c("zone") % 5 != 0).withColumn("population", c("households") * 4)).select("cell"))
add("cells_floorspace", "a_cells", """WITH f AS (SELECT cell, zone, area_sqm, com_sqm AS area, CASE WHEN cell % 4 = 0 THEN NULL ELSE slope_pct END AS height FROM a_cells WHERE com_sqm > 0),
  s AS (SELECT cell, area * greatest(1, coalesce(round_even(height / 3.2e0, 0), 1 + zone % 4)) AS floors, area, (zone % 10) / 10e0 AS share FROM f)
  SELECT a.cell, round(least(1, coalesce(s.area / a.area_sqm, 0)), 6) AS builtup_frac, round(coalesce(floors * share, 0), 6) AS floorspace_res_sqm, round(coalesce(floors * (1 - share), 0), 6) AS floorspace_com_sqm FROM a_cells a LEFT JOIN s USING (cell)""",
    lambda x: cc.floorspace(x.filter("com_sqm > 0").select("cell", c("com_sqm").alias("area"), F.when(c("cell") % 4 != 0, c("slope_pct")).alias("height")), x.select("cell", "zone", "area_sqm"),
                            x.select("zone", (1 + c("zone") % 4).alias("storeys"), (c("zone") % 10 / 10.0).alias("res_share")).distinct()))
add("footprint_history", "a_cells", """WITH y AS (SELECT * FROM (VALUES (2016::BIGINT, 1e0), (2020::BIGINT, 2e0), (2024::BIGINT, 3e0)) t(year, k)), f AS (SELECT cell, year, com_sqm * k * 4 AS area FROM a_cells, y WHERE com_sqm > 0 AND (year <> 2020 OR cell % 2 = 0))
  SELECT a.cell, y.year, round(least(1, coalesce(f.area / a.area_sqm, 0)), 6) AS builtup_frac FROM a_cells a CROSS JOIN y LEFT JOIN f ON f.cell = a.cell AND f.year = y.year""",
    lambda x: cc.footprint_history({y: x.filter("com_sqm > 0" if y != 2020 else "com_sqm > 0 AND cell % 2 = 0").select("cell", (c("com_sqm") * k * 4).alias("area")) for y, k in ((2016, 1), (2020, 2), (2024, 3))}, x))
add("fractions_checked", "a_cells", "WITH w AS (SELECT zone, land_type, sum(area_sqm) AS w FROM a_cells GROUP BY ALL) SELECT zone, round(sum(w) / sum(w), 6) AS total, count(*) AS n FROM w GROUP BY zone",
    lambda x: cc.check_fractions(ms.fractions(x, "zone", "land_type", "area_sqm"), "zone", "frac", P.value("ingest.min_fraction_sum_error")).groupBy("zone").agg(F.sum("frac").alias("total"), F.count(F.lit(1)).alias("n")))
add("coastal_class", "a_cells", """WITH p AS (SELECT cell, z AS zone, area_sqm * CASE z WHEN 'I' THEN (cell % 3) / 4e0 ELSE (cell % 4) / 6e0 END AS area FROM a_cells, (VALUES ('I'), ('II')) t(z) WHERE cell % 5 <> 0),
  r AS (SELECT cell, zone, row_number() OVER (PARTITION BY cell ORDER BY area DESC, zone) AS r FROM p) SELECT a.cell, coalesce(r.zone, 'none') AS crz_class FROM a_cells a LEFT JOIN r ON r.cell = a.cell AND r = 1""",
    lambda x: cc.coastal_class(x, x.filter("cell % 5 <> 0").select("cell", F.explode(F.array(F.struct(F.lit("I").alias("zone"), (c("area_sqm") * ((c("cell") % 3) / 4.0)).alias("area")), F.struct(F.lit("II").alias("zone"), (c("area_sqm") * ((c("cell") % 4) / 6.0)).alias("area")))).alias("p")).select("cell", "p.zone", "p.area"), True))
add("utilities_served", "a_cells", "SELECT cell, CASE WHEN cell % 7 <> 0 AND amenity >= 0.5 THEN 1 ELSE 0 END::BIGINT AS util_water, CASE WHEN cell % 7 <> 0 AND amenity >= 0.5 AND disamenity >= 0.5 THEN 1 ELSE 0 END::BIGINT AS util_sewer FROM a_cells",
    lambda x: cc.utilities_served(x, x.filter("cell % 7 <> 0").select("cell", c("amenity").alias("water"), c("disamenity").alias("sewer"))))
add("parcel_fragmentation", "lineitem a_cells", "SELECT a.cell, coalesce(n, 0) AS parcel_count, round(mean / 0.6e0, 6) AS mean_parcel_sqm FROM a_cells a LEFT JOIN (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS mean FROM lineitem GROUP BY l_partkey) f ON f.l_partkey = a.cell",
    lambda h, x: cc.fragmentation(h.select(c("l_partkey").alias("cell"), c("l_quantity").alias("area")), x, 0.6))
add("light_of_year", "a_history a_cells", "WITH y AS (SELECT CASE WHEN count(*) FILTER (year = 2005) > 0 THEN 2005 ELSE max(year) END AS year FROM a_history) SELECT a.cell, round(light, 6) AS light, CASE WHEN light IS NOT NULL THEN y.year END AS year_used FROM a_cells a CROSS JOIN y LEFT JOIN a_history h ON h.cell = a.cell AND h.year = y.year",
    lambda h, x: cc.year_or_latest(h, x, "light", 2005))
SQUARES = "SELECT *, x0 + side AS x1, y0 + side AS y1 FROM (SELECT s_suppkey AS locality, (s_suppkey % 40) * 500e0 - 130e0 AS x0, (s_suppkey % 45) * 433e0 - 70e0 AS y0, 700e0 AS side, s_acctbal AS value FROM supplier)"


def _squares(s: DataFrame) -> DataFrame:
    x0, y0 = (c("s_suppkey") % 40) * 500.0 - 130.0, (c("s_suppkey") % 45) * 433.0 - 70.0
    corner = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    return s.select(c("s_suppkey").alias("locality"), c("s_acctbal").alias("value"), F.array(corner(0.0, 0.0), corner(700.0, 0.0), corner(700.0, 700.0), corner(0.0, 700.0)).alias("ring"))


add("guidance_by_polygon", "supplier a_cells", f"""WITH s AS ({SQUARES}), m AS (SELECT cell, value, row_number() OVER (PARTITION BY cell ORDER BY locality, value) AS r FROM a_cells JOIN s ON x_m > x0 AND x_m < x1 AND y_m > y0 AND y_m < y1)
  SELECT a.cell, round(value, 6) AS value FROM a_cells a LEFT JOIN m ON m.cell = a.cell AND r = 1""", lambda s, x: cc.values_by_polygon(x, _squares(s), "value", "locality"))
add("project_cells", "supplier a_sites", f"""WITH s AS ({SQUARES}), p AS (SELECT project_id, x + 3.7e0 AS x, y + 1.3e0 AS y FROM a_sites), m AS (SELECT project_id, locality, row_number() OVER (PARTITION BY project_id ORDER BY locality) AS r FROM p JOIN s ON x > x0 AND x < x1 AND y > y0 AND y < y1)
  SELECT project_id, locality AS cell FROM m WHERE r = 1""", lambda s, p: cc.project_cells(p.select("project_id", (c("x") + 3.7).alias("x"), (c("y") + 1.3).alias("y")), _squares(s).withColumnRenamed("locality", "cell")).select("project_id", "cell"))
add("listing_medians", "lineitem a_cells", """WITH l AS (SELECT l_orderkey AS listing, l_partkey AS cell, l_extendedprice AS ask, l_quantity AS rent, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_extendedprice, l_quantity) AS r FROM lineitem),
  m AS (SELECT cell, quantile_cont(ask, 0.5) AS ask, quantile_cont(rent, 0.5) AS rent, count(*) AS n FROM l WHERE r = 1 GROUP BY cell) SELECT a.cell, round(CASE WHEN n >= 2 THEN m.ask END, 6) AS ask, round(CASE WHEN n >= 2 THEN m.rent END, 6) AS rent, coalesce(n, 0) AS n FROM a_cells a LEFT JOIN m USING (cell)""",
    lambda h, x: cc.listings(cc.first_match(h, ["l_orderkey"], ["l_partkey", "l_extendedprice", "l_quantity"]).select(c("l_orderkey").alias("listing"), c("l_partkey").alias("cell"), c("l_extendedprice").alias("ask"), c("l_quantity").alias("rent")), x, "ask", "rent", 2))
add("jobs_proxy", "a_cells", "SELECT cell, retail_poi * 6e0 AS retail_svc, education_poi * 25e0 + health_poi * 40e0 AS public_edu, 0e0 AS agri FROM a_cells",
    lambda x: x.select("cell", cc.jobs_proxy({k: c(k) for k in ("retail_poi", "education_poi", "health_poi")}, {"retail_poi": ("retail_svc", 6.0), "education_poi": ("public_edu", 25.0), "health_poi": ("public_edu", 40.0)}).alias("j")).select("cell", c("j")[5].alias("retail_svc"), c("j")[6].alias("public_edu"), c("j")[0].alias("agri")))
add("households_from_people", "a_cells", "SELECT cell, round(households * 4 / 4.25e0, 6) AS households FROM a_cells", lambda x: x.select("cell", cc.households(c("households") * 4, {"low": 5.0, "mid": 4.5, "upper_mid": 4.0, "high": 3.5}).alias("households")))
add("raster_population", "lineitem a_cells", "SELECT a.cell, round(coalesce(p, 0), 6) AS population FROM a_cells a LEFT JOIN (SELECT l_partkey, sum(l_quantity * l_discount) AS p FROM lineitem GROUP BY l_partkey) t ON t.l_partkey = a.cell",
    lambda h, x: cc.raster_population(h.select(c("l_partkey").alias("cell"), c("l_quantity").alias("value"), c("l_discount").alias("weight")), x))


def _roads(x: DataFrame, brand: str) -> DataFrame:
    """A straight road of 1200 m to the east of each cell of a brand."""
    return x.filter(c("brand") == brand).select(F.array(F.struct(c("x_m").alias("x"), (c("y_m") + 50.0).alias("y")), F.struct((c("x_m") + 1200.0).alias("x"), (c("y_m") + 50.0).alias("y"))).alias("line"))


ROAD = "least({reach}e0, coalesce((SELECT min(sqrt(pow(greatest(0, r.x_m - a.x_m, a.x_m - r.x_m - 1200), 2) + pow(a.y_m - r.y_m - 50, 2))) FROM a_cells r WHERE r.brand = '{brand}'), {reach}e0))"
add("cell_distances", "a_cells", f"SELECT a.cell, round(sqrt(pow(x_m - 10000, 2) + pow(y_m - 10000, 2)), 6) AS dist_cbd_m, round({ROAD.format(reach=3000, brand='Brand#22')}, 6) AS dist_arterial_m, round({ROAD.format(reach=3000, brand='Brand#13')}, 6) AS dist_coast_m FROM a_cells a",
    lambda x: cc.distances(x, (10000.0, 10000.0), _roads(x, "Brand#22"), _roads(x, "Brand#13"), 3000.0))
add("power_flag", "a_cells", f"SELECT a.cell, CASE WHEN EXISTS (SELECT 1 FROM a_cells s WHERE s.brand = 'Brand#13' AND sqrt(pow(a.x_m - s.x_m - 20, 2) + pow(a.y_m - s.y_m, 2)) <= 2000) OR {ROAD.format(reach=1000, brand='Brand#22')} <= 500 THEN 1 ELSE 0 END::BIGINT AS util_power FROM a_cells a",
    lambda x: cc.powered(x, x.filter("brand = 'Brand#13'").select((c("x_m") + 20.0).alias("x"), c("y_m").alias("y")), _roads(x, "Brand#22")))
add("regional_uplift", "a_cells", """WITH o AS (SELECT cell, zone, price / raw_price * (1 + cell % 5) AS y, ln(1 + sqrt(pow(x_m - 10000, 2) + pow(y_m - 10000, 2))) AS x FROM a_cells WHERE price > 0 AND raw_price > 0 AND cell % 4 <> 0),
  n AS (SELECT zone, count(*) AS n FROM o GROUP BY zone), l AS (SELECT o.*, CASE WHEN n >= 3 THEN CAST(zone AS VARCHAR) ELSE '' END AS lv FROM o JOIN n USING (zone)), m AS (SELECT lv, avg(y) AS my, avg(x) AS mx FROM l GROUP BY lv),
  b AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS b FROM l JOIN m USING (lv)), w AS (SELECT avg(y) AS ay, avg(x) AS ax FROM o),
  k AS (SELECT a.cell, ln(1 + sqrt(pow(x_m - 10000, 2) + pow(y_m - 10000, 2))) AS x, CASE WHEN n.n >= 3 THEN CAST(a.zone AS VARCHAR) ELSE '' END AS lv FROM a_cells a LEFT JOIN n USING (zone))
  SELECT k.cell, round(coalesce(o.y, coalesce(my, ay) + b * (k.x - coalesce(mx, ax))), 6) AS uplift FROM k LEFT JOIN m USING (lv) CROSS JOIN b CROSS JOIN w LEFT JOIN o ON o.cell = k.cell""",
    lambda x: cc.uplift(x.filter("cell % 4 <> 0").select("cell", (c("price") * (1 + c("cell") % 5)).alias("broker")), x.select("cell", c("raw_price").alias("registered")), x.select("cell", "zone", F.hypot(c("x_m") - 10000, c("y_m") - 10000).alias("dist_cbd_m")), P))
add("coverage_gate", "a_cells", """SELECT 'price' AS "column", round(avg(CASE WHEN price IS NOT NULL THEN 1e0 ELSE 0 END), 6) AS real FROM a_cells""",
    lambda x: govern.check_coverage(ms.coverage(x, "cell", ["price"], x.filter("false").select("cell", F.lit("").alias("column")), 0.5), {"price": 0.5}).select("column", "real"))
add("imputation_rows", "a_cells", """SELECT cell, 'price' AS "column", 'median' AS method, 'r' AS run_id FROM a_cells WHERE price IS NULL UNION ALL SELECT cell, 'rent', 'parent', 'r' FROM a_cells WHERE rent IS NULL""",
    lambda x: ledger.imputation_rows(ingest.mark_imputed(ingest.mark_imputed(x, "price", c("price").isNull(), "median"), "rent", c("rent").isNull(), "parent"), "cell", "r"))
add("ledger_upsert", "orders", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS rows FROM orders",
    lambda o: ledger.upsert_runs(o.select(c("o_orderkey").cast("string").alias("run_id"), c("o_totalprice").alias("rows")), o.filter("o_orderstatus = 'F'").select(c("o_orderkey").cast("string").alias("run_id"), (c("o_totalprice") + 1).alias("rows"))))
POLICY = {"collect": "green", "deliver": "amber", "none": "red"}
add("dependency_audit", "part", """WITH i AS (SELECT p_brand AS package, CAST(p_size AS VARCHAR) AS version, CASE p_partkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Collect' WHEN 2 THEN 'deliver' ELSE 'other' END AS licence FROM part GROUP BY ALL),
  k AS (SELECT *, CASE lower(licence) WHEN 'collect' THEN 'green' WHEN 'deliver' THEN 'amber' WHEN 'none' THEN 'red' ELSE 'unknown' END AS class, package IN ('Brand#1', 'Brand#2', 'Brand#3') AS direct FROM i)
  SELECT package, version, licence, class, CASE WHEN class = 'red' THEN 'licence not permitted' WHEN class = 'unknown' AND direct THEN 'licence unknown' WHEN direct AND package <> 'Brand#1' THEN 'not documented' END AS problem FROM k""",
    lambda x: govern.dependency_audit(x.select(c("p_brand").alias("package"), c("p_size").cast("string").alias("version"), F.element_at(F.array(*[F.lit(v) for v in ("None", "Collect", "deliver", "other")]), (c("p_partkey") % 4 + 1).cast("int")).alias("licence")).distinct(),
                                     x.sparkSession.createDataFrame(list(POLICY.items()), "licence string, class string"), ["Brand#1", "brand#2", "Brand#3"], ["BRAND#1"]))

add("grid_k_ring", "a_cells", """WITH g AS (SELECT cell, cell % 40 AS q, CAST(floor(cell / 40) AS BIGINT) AS r FROM a_cells) SELECT a.cell, b.cell AS other FROM g a JOIN g b ON abs(a.q - b.q) <= 2 AND abs(a.r - b.r) <= 2 AND abs(a.q + a.r - b.q - b.r) <= 2 AND a.cell <> b.cell""",
    lambda x: ingest.neighbours(x.select("cell", (c("cell") % 40).alias("q"), F.floor(c("cell") / 40).alias("r")), 2))
add("population_refined", "a_cells", """WITH p AS (SELECT zone + d AS ward, 1000e0 + 10 * (zone + d) AS people, cell, (1 + (cell + d) % 3) * 100e0 AS area FROM a_cells, (VALUES (0), (1)) t(d) WHERE cell % 11 <> 0),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY area DESC, ward DESC) AS r FROM p) WHERE r = 1), w AS (SELECT b.*, CASE WHEN ward % 4 = 0 THEN 0 ELSE res_sqm END AS w FROM b JOIN a_cells USING (cell)),
  s AS (SELECT *, sum(w) OVER z AS tw, sum(area) OVER z AS ta FROM w WINDOW z AS (PARTITION BY ward))
  SELECT a.cell, round(coalesce(people * CASE WHEN tw < 50 THEN s.area / ta ELSE w / tw END, 0), 6) AS population, coalesce(tw < 50, FALSE) AS unweighted FROM a_cells a LEFT JOIN s USING (cell)""", lambda x: _refined(x))


def _refined(x: DataFrame) -> DataFrame:
    d = F.explode(F.array(F.lit(0), F.lit(1))).alias("d")
    pieces = x.filter("cell % 11 <> 0").select("cell", "zone", d).select("cell", (c("zone") + c("d")).alias("ward"), (1000.0 + 10 * (c("zone") + c("d"))).alias("people"), ((1 + (c("cell") + c("d")) % 3) * 100.0).alias("area"))
    ward = pieces.groupBy("cell").agg(F.max(F.struct("area", "ward")).alias("b")).select("cell", "b.ward")
    weights = x.select("cell", "res_sqm").join(ward, "cell", "left").select("cell", F.when(c("ward") % 4 == 0, 0.0).otherwise(c("res_sqm")).alias("weight"))
    return sub.refine_population(pieces, weights, 50.0)


add("elasticity_regressed", "a_cells", "SELECT cell, round(exp(0.3e0 + 0.5e0 * ln(1 - coalesce(undevelopable_frac, 0) + 0.01e0) - 0.2e0 * amenity + 0.1e0 * ln(1 - builtup_frac + 0.01e0) + 0.05e0 * ln(CASE WHEN mean_parcel_sqm > 0 THEN mean_parcel_sqm END)), 6) AS eps FROM a_cells",
    lambda x: sub.regressed_elasticity(x.fillna(0.0, ["undevelopable_frac"]).withColumn("regulatory_index", c("amenity")), {"intercept": 0.3, "_open": 0.5, "regulatory_index": -0.2, "_unbuilt": 0.1, "_parcel": 0.05}).select("cell", "eps"))

# --- detection -------------------------------------------------------------------------------------------------
add("sat_monthly", "a_pixels", """WITH p AS (SELECT project_id, CAST(date_trunc('month', time) AS DATE) AS month, px, scl NOT IN (3, 8, 9, 10) AS ok, b02, b03, b04, b08, b11 FROM a_pixels),
  m AS (SELECT project_id, month, px, quantile_cont(b02, 0.5) FILTER (ok) AS b02, quantile_cont(b03, 0.5) FILTER (ok) AS b03, quantile_cont(b04, 0.5) FILTER (ok) AS b04, quantile_cont(b08, 0.5) FILTER (ok) AS b08, quantile_cont(b11, 0.5) FILTER (ok) AS b11,
    count(*) AS n, count(*) FILTER (NOT ok) AS bad FROM p GROUP BY ALL),
  a AS (SELECT project_id, month, avg((b08 - b04) / nullif(b08 + b04, 0)) AS ndvi, avg((b11 - b08) / nullif(b11 + b08, 0)) AS ndbi, avg((b11 + b04 - b08 - b02) / nullif(b11 + b04 + b08 + b02, 0)) AS bsi, avg((b02 + b03 + b04) / 3) AS brightness,
    sum(bad) / sum(n) AS cloud_frac, avg(CASE WHEN bad < n THEN 1e0 ELSE 0 END) AS clear FROM m GROUP BY ALL)
  SELECT project_id, month, round(ndvi + 1e-9, 6) AS ndvi, round(ndbi + 1e-9, 6) AS ndbi, round(bsi + 1e-9, 6) AS bsi, round(brightness + 1e-9, 6) AS brightness, round(cloud_frac + 1e-9, 6) AS cloud_frac, cloud_frac <= 0.4 AND clear >= 0.5 AND ndvi IS NOT NULL AS valid FROM a""",
    lambda p: detection.monthly(p, P).withColumns({n: c(n) + TIE for n in ("ndvi", "ndbi", "bsi", "brightness", "cloud_frac")}))
DETECT = """b AS (SELECT project_id, avg(ndvi) FILTER (valid) AS v0, avg(ndbi) FILTER (valid) AS b0, avg(bsi) FILTER (valid) AS s0, avg(light) AS l0 FROM a_months WHERE month < DATE '1995-06-01' GROUP BY project_id HAVING count(*) FILTER (valid) >= 3),
  d AS (SELECT m.*, ndvi - v0 AS dv, ndbi - b0 AS db, bsi - s0 AS ds, coalesce(CASE WHEN l0 <> 0 THEN (light - l0) / abs(l0) END > 0.3, FALSE) AS rose FROM a_months m JOIN b USING (project_id)),
  e AS (SELECT *, CASE WHEN valid THEN CASE WHEN db > 0.1 AND rose THEN 5 WHEN db > 0.1 THEN 4 WHEN dv < -0.15 AND ds > 0.08 AND db < 0.1 THEN 3 WHEN dv < -0.15 AND db < 0.05 THEN 2 ELSE 1 END END AS k FROM d),
  f AS (SELECT *, CASE WHEN k IS NOT NULL THEN max(k) OVER (PARTITION BY project_id ORDER BY month ROWS UNBOUNDED PRECEDING) END AS top FROM e)"""
NAMED = "['none', 'cleared', 'earthworks', 'structure', 'operational']"


def _projects(m: DataFrame) -> DataFrame:
    return m.select("project_id").distinct().withColumn("announced_date", F.lit("1995-06-01").cast("date"))


add("sat_detect", "a_months", f"WITH {DETECT} SELECT project_id, month, round(dv + 1e-9, 6) AS dndvi, round(db + 1e-9, 6) AS dndbi, round(ds + 1e-9, 6) AS dbsi, rose AS light_rose, {NAMED}[k] AS state, {NAMED}[top] AS state_cum FROM f",
    lambda m: detection.detect(m, _projects(m), P, "skip").select("project_id", "month", *[(c(n) + TIE).alias(n) for n in ("dndvi", "dndbi", "dbsi")], "light_rose", "state", "state_cum"))
add("sat_baseline", "a_months", f"WITH {DETECT} SELECT project_id, round(v0 + 1e-9, 6) AS ndvi0, round(b0 + 1e-9, 6) AS ndbi0, round(s0 + 1e-9, 6) AS bsi0, round(l0 + 1e-9, 6) AS light0 FROM b",
    lambda m: detection.baselines(m, _projects(m), P, "skip").withColumns({n: c(n) + TIE for n in ("ndvi0", "ndbi0", "bsi0", "light0")}))
# all projects: those with too few months for a baseline are in no state since their first month
add("sat_latest_state", "a_part_months", f"""WITH {DETECT.replace("a_months", "a_part_months")}, l AS (SELECT project_id, arg_max({NAMED}[top], month) FILTER (top IS NOT NULL) AS s, max(month) FILTER (top IS NOT NULL) AS m FROM f GROUP BY project_id)
  SELECT project_id, coalesce(s, 'none') AS physical_state, coalesce(m, first) AS physical_asof FROM (SELECT project_id, min(month) AS first FROM a_part_months GROUP BY project_id) LEFT JOIN l USING (project_id)""",
    lambda m: detection.latest_states(detection.detect(m, _projects(m), P, "null")))

# --- score cards and the gate ----------------------------------------------------------------------------------
add("bt_gate", "a_cards", f"""WITH v AS (SELECT beat_b2 AS v, row_number() OVER (ORDER BY city, t0) - 1 AS k, count(*) OVER () AS n FROM a_cards WHERE price_test AND beat_b2 IS NOT NULL),
  x0 AS (SELECT i, j, n, ({P.value('gate.seed')} % {PRIME} + i * 69621 + j * 48271) % {PRIME} AS x FROM range(2000) a(i), (SELECT k AS j, n FROM v)),
  x1 AS (SELECT i, j, n, (((x * x + 12345 + i) % {PRIME}) * 16807 + j) % {PRIME} AS x FROM x0), x2 AS (SELECT i, ((x * x + 67891) % {PRIME}) % n AS k FROM x1),
  ci AS (SELECT quantile_cont(m, 0.05) AS low FROM (SELECT i, quantile_cont(v.v, 0.5) AS m FROM x2 JOIN v ON v.k = x2.k GROUP BY i)),
  g AS (SELECT count(DISTINCT city)::DOUBLE AS cities, count(*) FILTER (NOT (underpowered OR n_zones < 20))::DOUBLE AS powered, count(*) AS n, quantile_cont(spearman, 0.5) FILTER (price_test) AS rho, quantile_cont(beat_b2, 0.5) FILTER (price_test) AS beat,
    quantile_cont(coverage, 0.5) FILTER (price_test) AS cover FROM a_cards)
  SELECT criterion, round(observed, 6) AS observed, passed FROM (SELECT unnest([
    {{'criterion': 'cities', 'observed': cities, 'passed': cities >= 3}}, {{'criterion': 'powered', 'observed': powered, 'passed': powered = n}}, {{'criterion': 'median_spearman', 'observed': rho, 'passed': rho > 0.55}},
    {{'criterion': 'median_beat_b2', 'observed': beat, 'passed': beat > 0}}, {{'criterion': 'beat_b2_ci_lower', 'observed': low, 'passed': low > 0}}, {{'criterion': 'median_coverage', 'observed': cover, 'passed': cover BETWEEN 0.7 AND 0.9}}], recursive := true) FROM g, ci)""",
    lambda d: scorecard.gate(d, P))
add("bt_reliability", "a_draws", """WITH q AS (SELECT cell, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b, quantile_cont(value, 0.25) AS e, quantile_cont(value, 0.75) AS f FROM a_draws WHERE draw > 0 GROUP BY cell), r AS (SELECT * FROM a_draws JOIN q USING (cell) WHERE draw = 0)
  SELECT 0.8e0 AS nominal, round(avg(CASE WHEN value BETWEEN a AND b THEN 1e0 ELSE 0 END), 6) AS observed FROM r UNION ALL SELECT 0.5e0, round(avg(CASE WHEN value BETWEEN e AND f THEN 1e0 ELSE 0 END), 6) FROM r""",
    lambda d: scorecard.reliability(d.filter("draw = 0").join(d.filter("draw > 0").groupBy("cell").agg(*[F.percentile("value", F.lit(q)).alias(n) for n, q in (("a", 0.1), ("b", 0.9), ("e", 0.25), ("f", 0.75))]), "cell"), "value", [(0.8, "a", "b"), (0.5, "e", "f")]))
add("bt_aligned", "a_cells a_history", "SELECT a.cell, round(a.price, 6) AS pred, round(h.price, 6) AS actual FROM a_cells a JOIN a_history h ON h.cell = a.cell AND h.year = 1998 WHERE a.price IS NOT NULL",
    lambda x, h: ms.aligned(x, h.filter("year = 1998"), ["cell"], "price"))
add("report_figures", "a_projects a_announcers", """WITH f AS (SELECT CAST(announcer_id AS VARCHAR) AS figure FROM a_announcers UNION ALL SELECT CAST(announcer_id AS VARCHAR) FROM a_announcers WHERE mean_capex = 0), r AS (SELECT DISTINCT CAST(announcer_id + 3 AS VARCHAR) AS figure FROM a_projects WHERE abandoned)
  SELECT figure, 'never made' AS problem FROM r WHERE figure NOT IN (SELECT figure FROM f) UNION ALL SELECT DISTINCT figure, 'never referenced' FROM f WHERE figure NOT IN (SELECT figure FROM r) UNION ALL SELECT figure, 'made twice' FROM f GROUP BY figure HAVING count(*) > 1""",
    lambda p, a: govern.figure_problems(p.filter("abandoned").select((c("announcer_id") + 3).cast("string").alias("figure")), a.select(c("announcer_id").cast("string").alias("figure")).unionByName(a.filter("mean_capex = 0").select(c("announcer_id").cast("string").alias("figure")))))
add("overheat_precision", "a_cells", "WITH m AS (SELECT quantile_cont(lna, 0.5) AS m FROM a_cells) SELECT round(avg(CASE WHEN lna < m THEN 1e0 ELSE 0 END), 6) AS overheat_precision FROM a_cells, m WHERE amenity > 0.8", lambda x: scorecard.overheat_precision(x, c("amenity") > 0.8, "lna"))
