"""Each operator as a query over the domain views, with independent DuckDB SQL for the same rows.

Doubles are rounded to six places on both sides: sums depend on the order of their terms.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import scalar as sc
from terrane.operators import access, cell_columns as cc, credibility as cr, govern, ingest, market, measures as ms, networks, spatial, substrate as sub
from terrane.params import load_params
from terrane.plans import backtest as bt
from terrane.plans.views import table, view, with_views
from terrane.schema import Col, Table
from terrane.sources.readers import adapter_for
from terrane.sources.ship import kept

P = load_params()
c = F.col
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(n, places).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


def add(name: str, views: str, sql: str | None, fn: Callable[..., DataFrame]) -> None:
    """Registers fn over these views or tables; sql sees the same names."""
    names = views.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames: list[Any] = [view(spark, sf_dir, n) if n.startswith("a_") else table(spark, sf_dir, n) for n in names]
        return rounded(fn(*frames))

    _QUERIES[name] = run
    if sql is not None:
        need = [n for n in names if n.startswith("a_")]
        prefix = with_views(*need) if need else ""
        body = sql.strip()
        if prefix and body.upper().startswith("WITH RECURSIVE "):
            prefix, body = "WITH RECURSIVE" + prefix[4:] + ",\n", body[15:]
        elif prefix and body.upper().startswith("WITH "):
            prefix, body = prefix + ",\n", body[5:]
        _SQL[name] = f"{prefix}\n{body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- substrate -------------------------------------------------------------------------------------------------
GATE = "CASE WHEN util_water = 1 AND util_sewer = 1 AND util_power = 1 THEN 'water_sewer_power' WHEN util_water = 1 AND util_sewer = 1 THEN 'water_sewer' WHEN util_water = 1 THEN 'water' ELSE 'none' END"
L0 = f"""
  s0 AS (SELECT *, least(greatest(coalesce(undevelopable_frac, 0) + CASE WHEN slope_pct > 15 THEN 1 ELSE 0 END, 0), 1) AS undev, {GATE} AS utility_state FROM a_cells),
  s1 AS (SELECT *, greatest(0, area_sqm * (1 - undev) * permitted_far * CASE utility_state WHEN 'none' THEN 0.15e0 WHEN 'water' THEN 0.4e0 WHEN 'water_sewer' THEN 0.8e0 ELSE 1e0 END
    * CASE WHEN mean_parcel_sqm >= 8094 THEN 1e0 WHEN mean_parcel_sqm >= 2023 THEN 0.8e0 WHEN mean_parcel_sqm >= 809 THEN 0.55e0 ELSE 0.3e0 END) AS capacity_sqm FROM s0),
  s2 AS (SELECT *, greatest(0, capacity_sqm - res_sqm - com_sqm) AS headroom_sqm FROM s1),
  l0 AS (SELECT *, CASE WHEN builtup_frac > 0.55 AND headroom_sqm / area_sqm < 0.5 THEN 'dense_core' WHEN undev > 0.35 THEN 'constrained_periph'
    WHEN builtup_frac < 0.10 AND util_water = 0 THEN 'open_fringe' ELSE 'typical_periph' END AS elasticity_class FROM s2),
  l0e AS (SELECT *, CASE elasticity_class WHEN 'dense_core' THEN 0.12e0 WHEN 'constrained_periph' THEN 0.5e0 WHEN 'open_fringe' THEN 2.75e0 ELSE 1.5e0 END AS eps FROM l0)
"""
add("l0_substrate", "a_cells", f"WITH {L0} SELECT cell, round(undev, 6) AS undev, utility_state, round(capacity_sqm, 6) AS capacity_sqm, round(headroom_sqm, 6) AS headroom_sqm, elasticity_class, eps FROM l0e",
    lambda x: sub.substrate(x, P).select("cell", "undev", "utility_state", "capacity_sqm", "headroom_sqm", "elasticity_class", "eps"))
add("l0_slope_cost", "a_cells", "SELECT cell, CASE WHEN slope_pct > 15 THEN -1e0 ELSE round(1 + 0.04e0 * greatest(0, slope_pct - 5), 6) END AS cost FROM a_cells",
    lambda x: x.select("cell", F.when(sub.slope_cost(c("slope_pct"), P) == float("inf"), -1.0).otherwise(sub.slope_cost(c("slope_pct"), P)).alias("cost")))
add("l0_class_summary", "a_cells", f"WITH {L0} SELECT zone, elasticity_class, count(*) AS n, round(sum(headroom_sqm), 6) AS headroom, round(avg(eps), 6) AS eps FROM l0e GROUP BY ALL",
    lambda x: sub.substrate(x, P).groupBy("zone", "elasticity_class").agg(F.count(F.lit(1)).alias("n"), F.sum("headroom_sqm").alias("headroom"), F.avg("eps").alias("eps")))
add("l0_jobs_dasymetric", "a_cells", """SELECT cell, round(sum(jobs) OVER z * CASE WHEN sum(com_sqm) OVER z > 0 THEN com_sqm / sum(com_sqm) OVER z ELSE 1e0 / count(*) OVER z END, 6) AS jobs_est
    FROM a_cells WINDOW z AS (PARTITION BY zone)""",
    lambda x: sub.spread_by_weight(x.withColumn("_t", F.expr("sum(jobs) over (partition by zone)")), "zone", c("_t"), c("com_sqm"), "jobs_est").select("cell", "jobs_est"))

# --- accessibility ---------------------------------------------------------------------------------------------
KMH = {"car": 26.0, "transit": 18.0, "walk": 4.5}
SHARES = {m: P.value(f"access.mode_share.{m}") for m in KMH}
_B = lambda k: P.value(f"access.beta.{k}")
BETAS = {"work": {m: _B(f"work_{m}") for m in KMH}, "retail": dict.fromkeys(KMH, _B("retail")), "education": dict.fromkeys(KMH, _B("education")), "health": dict.fromkeys(KMH, _B("health"))}
WEIGHTS = {k: P.value(f"access.purpose_weight.{k}") for k in BETAS}
MIN_JOBS, MAX_DESTINATIONS = P.value("access.min_destination_jobs"), P.value("access.max_destinations")
DEST = f"""zone_jobs AS (SELECT zone, sum(jobs) AS jobs, avg(x_m) AS zx, avg(y_m) AS zy FROM a_cells GROUP BY zone),
  dest AS (SELECT * FROM zone_jobs WHERE jobs >= {MIN_JOBS} OR (SELECT max(jobs) FROM zone_jobs) < {MIN_JOBS} ORDER BY jobs DESC, zone LIMIT {MAX_DESTINATIONS})"""
OD = f"""{DEST}, od1 AS (SELECT cell, dest.zone, sqrt((x_m - zx) * (x_m - zx) + (y_m - zy) * (y_m - zy)) AS d FROM a_cells, dest),
  od AS (SELECT cell, zone, mode, d / 1000 / kmh * 60 AS minutes FROM od1, (VALUES ('car', 26e0), ('transit', 18e0), ('walk', 4.5e0)) m(mode, kmh))"""


def _pairs(cells: DataFrame) -> DataFrame:
    """All origins with all selected destinations and their opportunities."""
    targets = access.destinations(cells, "zone", "jobs", MIN_JOBS, MAX_DESTINATIONS).drop("jobs").join(access.opportunities(cells, "zone", P), "zone")
    return access.od_pairs(cells, targets, "cell", "zone")


OPP = """opp AS (SELECT zone, sum(jobs) AS o_work, sum(CASE WHEN retail_poi > 0 AND com_sqm > 0 THEN com_sqm ELSE 120 * retail_poi END) AS o_retail,
  sum(CASE WHEN school_seats > 0 THEN school_seats ELSE 400 * education_poi END) AS o_education, sum(CASE WHEN beds > 0 THEN beds ELSE 30 * health_poi END) AS o_health FROM a_cells GROUP BY zone)"""
add("l1_opportunities", "a_cells", f"WITH {OPP} SELECT zone, round(o_work, 6) AS o_work, round(o_retail, 6) AS o_retail, round(o_education, 6) AS o_education, round(o_health, 6) AS o_health FROM opp", lambda x: access.opportunities(x, "zone", P))
SHARE = "CASE mode WHEN 'car' THEN 0.11e0 WHEN 'transit' THEN 0.20e0 ELSE 0.21e0 END"
add("l1_gravity", "a_cells", f"""WITH {OD}, {OPP},
  g AS (SELECT cell, ln(1 + sum({SHARE} * exp(-minutes * CASE mode WHEN 'car' THEN 0.045e0 WHEN 'transit' THEN 0.037e0 ELSE 0.16e0 END) * o_work)) AS lna_work,
    ln(1 + sum({SHARE} * exp(-0.12e0 * minutes) * o_retail)) AS lna_retail, ln(1 + sum({SHARE} * exp(-0.075e0 * minutes) * o_education)) AS lna_education,
    ln(1 + sum({SHARE} * exp(-0.027e0 * minutes) * o_health)) AS lna_health FROM od JOIN opp USING (zone) GROUP BY cell)
  SELECT cell, round(lna_work, 6) AS lna_work, round(lna_retail, 6) AS lna_retail, round(lna_education, 6) AS lna_education, round(lna_health, 6) AS lna_health,
    round(0.55e0 * lna_work + 0.2e0 * lna_retail + 0.15e0 * lna_education + 0.1e0 * lna_health, 6) AS lna FROM g""",
    lambda x: access.gravity(_pairs(x), "cell", KMH, SHARES, BETAS, WEIGHTS))
add("l1_reachable_jobs", "a_cells", f"""WITH {OD}, {OPP} SELECT cell, {', '.join(f'round(sum(CASE WHEN minutes <= {t} THEN {SHARE} * o_work ELSE 0 END), 6) AS jobs_{t}' for t in (5, 10, 20))} FROM od JOIN opp USING (zone) GROUP BY cell""",
    lambda x: access.reachable(_pairs(x), "cell", KMH, SHARES, "o_work", [5, 10, 20]))
add("l1_station_weight", "a_cells", """WITH st AS (SELECT cell AS station, x_m AS sx, y_m AS sy, cell % 2 = 0 AS feeder FROM a_cells WHERE brand = 'Brand#13'),
  p AS (SELECT a.cell, feeder, sqrt((x_m - sx) * (x_m - sx) + (y_m - sy) * (y_m - sy)) AS d FROM a_cells a, st)
  SELECT cell, max(CASE WHEN d <= 400 THEN 1e0 WHEN d <= 800 THEN 0.6e0 WHEN d <= 1200 THEN 0.3e0 WHEN d <= 1600 THEN 0.12e0 WHEN d <= 6000 AND feeder THEN 0.15e0 ELSE 0e0 END) AS station_weight FROM p WHERE d <= 6000 GROUP BY cell""",
    lambda x: access.station_weight(spatial.within(x, x.filter("brand = 'Brand#13'").select(c("cell").alias("station"), c("x_m").alias("sx"), c("y_m").alias("sy"), (c("cell") % 2 == 0).alias("feeder")), 6000.0, "x_m", "y_m", "sx", "sy"), "cell", "dist_m", "feeder", P))
add("l1_destinations", "a_cells", f"WITH {DEST} SELECT zone, jobs, round(zx, 6) AS x_m, round(zy, 6) AS y_m FROM dest",
    lambda x: access.destinations(x, "zone", "jobs", MIN_JOBS, MAX_DESTINATIONS))
add("l1_congestion", "a_cells", "SELECT cell, round(30 / greatest(0.45e0, 1 - 0.35e0 * (builtup_frac + builtup_frac / 2 + builtup_frac * builtup_frac) / 3), 6) AS minutes FROM a_cells",
    lambda x: x.select("cell", access.congested(F.lit(30.0), c("builtup_frac"), c("builtup_frac") / 2, c("builtup_frac") * c("builtup_frac"), P).alias("minutes")))
add("l1_origins", "a_cells", "WITH c AS (SELECT *, households * 4 AS population, absorbed - 1500 AS headroom FROM a_cells WHERE zone % 5 <> 0) SELECT cell FROM c WHERE population > 0 OR headroom > 0 OR NOT (SELECT bool_or(population > 0 OR headroom > 0) FROM c)",
    lambda x: networks.origins(x.withColumn("in_city", c("zone") % 5 != 0).withColumn("population", c("households") * 4).withColumn("headroom_sqm", c("absorbed") - 1500)).select("cell"))
add("l1_rail_min_plus", "a_cells", """WITH s AS (SELECT cell, x_m, y_m FROM a_cells WHERE brand = 'Brand#13'),
  w AS (SELECT a.cell AS origin, s.cell AS station, sqrt((a.x_m - s.x_m) * (a.x_m - s.x_m) + (a.y_m - s.y_m) * (a.y_m - s.y_m)) AS m FROM a_cells a, s),
  h AS (SELECT a.cell AS board, b.cell AS alight, sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) AS m FROM s a, s b WHERE a.cell <> b.cell)
  SELECT p.origin, q.origin AS destination, round(min(p.m / 75 + h.m / 533 + q.m / 75 + 6), 6) AS minutes FROM w p JOIN h ON h.board = p.station AND h.m <= 2500 JOIN w q ON q.station = h.alight WHERE p.m <= 1500 AND q.m <= 1500 GROUP BY ALL""",
    lambda x: _rail(x))


def _rail(x: DataFrame) -> DataFrame:
    s = x.filter("brand = 'Brand#13'").select(c("cell").alias("station"), c("x_m").alias("sx"), c("y_m").alias("sy"))
    walk = spatial.within(x, s, 1500.0, "x_m", "y_m", "sx", "sy").select("cell", "station", (c("dist_m") / 75).alias("walk"))
    other = s.select(c("station").alias("alight"), c("sx").alias("ox"), c("sy").alias("oy"))
    rail = spatial.within(s, other, 2500.0, "sx", "sy", "ox", "oy").filter("station <> alight").select(c("station").alias("board"), "alight", (c("dist_m") / 533).alias("haul"))
    into = walk.select(c("cell").alias("origin"), c("station").alias("board"), c("walk").alias("walk_in"))
    return access.via_rail(into, rail, walk.select(c("cell").alias("destination"), c("station").alias("alight"), c("walk").alias("walk_out")), 6.0)


STATES = """h AS (SELECT CAST(project_id AS VARCHAR) AS id, CAST(ceil(open_year) AS BIGINT) AS y FROM a_projects WHERE is_public AND stage = 'half_complete' AND open_year IS NOT NULL),
  st AS (SELECT CAST(y.year AS BIGINT) AS year, count(id) AS n_open, '[' || coalesce(string_agg('"' || id || '"', ',' ORDER BY id), '') || ']' AS ids FROM range(1998, 2008) y(year) LEFT JOIN h ON h.y <= y.year GROUP BY y.year)"""
add("l1_network_states", "a_projects", f"WITH {STATES} SELECT year, n_open, sha256(ids) AS state FROM st",
    lambda x: networks.network_states(x.filter("is_public AND stage = 'half_complete'"), x.sparkSession.range(1998, 2008).withColumnRenamed("id", "year"), P))

# --- credibility -----------------------------------------------------------------------------------------------
#: Products of short decimals often end in a 5 at the seventh place, where the engines' round() differ; added on both sides.
TIE = 1e-9
MODS = ["multilateral_funded", "state_budget_only", "ec_pending", "site_pre_owned"]
HARD = "CASE commitment_form WHEN 'verbal' THEN 0.08e0 WHEN 'summit_mou' THEN 0.15e0 WHEN 'land_allotted' THEN 0.47e0 WHEN 'board_approved' THEN 0.57e0 ELSE 0.84e0 END"
CRED = f"""
  j AS (SELECT p.*, a.delivery_ratio, a.median_slip_months, a.mean_capex, {HARD} AS hard FROM a_projects p LEFT JOIN a_announcers a USING (announcer_id)),
  k AS (SELECT *, 0.55e0 + (0.30e0 * CASE WHEN delivery_ratio >= 0.85 THEN 1e0 WHEN delivery_ratio >= 0.65 THEN 0.85e0 WHEN delivery_ratio >= 0.45 THEN 0.65e0 WHEN delivery_ratio >= 0.25 THEN 0.45e0 WHEN delivery_ratio >= 0 THEN 0.25e0 ELSE 0.40e0 END
    + 0.15e0 * CASE WHEN median_slip_months IS NULL THEN 0.5e0 ELSE greatest(0, least(1, 1 - median_slip_months / 60)) END
    + 0.20e0 * CASE WHEN capex IS NULL OR mean_capex IS NULL OR mean_capex <= 0 THEN 0.5e0 WHEN capex / mean_capex <= 0.5 THEN 1e0 WHEN capex / mean_capex <= 1.5 THEN 0.85e0 WHEN capex / mean_capex <= 3 THEN 0.55e0 WHEN capex / mean_capex <= 6 THEN 0.3e0 WHEN capex / mean_capex <= 999 THEN 0.15e0 ELSE 0.5e0 END
    + 0.20e0 * hard + 0.15e0 * 0.5e0) / (0.30e0 + 0.15e0 + 0.20e0 + 0.20e0 + 0.15e0) * (1.35e0 - 0.55e0) AS acs FROM j),
  m AS (SELECT *, least(0.97e0, CASE WHEN is_public THEN CASE stage WHEN 'announced' THEN 0.27e0 WHEN 'feasibility' THEN 0.40e0 WHEN 'dpr_prepared' THEN 0.50e0 WHEN 'dpr_approved' THEN 0.61e0 WHEN 'funded' THEN 0.77e0 WHEN 'land_majority' THEN 0.87e0 WHEN 'construction' THEN 0.92e0 ELSE 0.97e0 END ELSE hard * acs END
    * (CASE WHEN modifier_bits % 2 = 1 THEN 1.15e0 ELSE 1e0 END * CASE WHEN floor(modifier_bits / 2) % 2 = 1 THEN 0.85e0 ELSE 1e0 END * CASE WHEN floor(modifier_bits / 4) % 2 = 1 THEN 0.85e0 ELSE 1e0 END * CASE WHEN floor(modifier_bits / 8) % 2 = 1 THEN 1.15e0 ELSE 1e0 END)) AS p0 FROM k),
  l3 AS (SELECT *, CASE WHEN abandoned THEN 0e0 WHEN claims_construction AND physical_state IN ('none', 'cleared') AND physical_age_days < 120 THEN p0 * 0.55e0 ELSE p0 END AS p_completion FROM m)
"""


def _completion(p: DataFrame, a: DataFrame) -> DataFrame:
    flags = [F.when(F.floor(c("modifier_bits") / 2**i) % 2 == 1, F.lit(m)) for i, m in enumerate(MODS)]
    return cr.completion(p.withColumn("modifiers", F.array_compact(F.array(*flags))), a, P)


add("l3_completion", "a_projects a_announcers", f"WITH {CRED} SELECT project_id, round(acs + 1e-9, 6) AS acs, round(p_completion + 1e-9, 6) AS p_completion FROM l3",
    lambda p, a: _completion(p, a).select("project_id", (c("acs") + TIE).alias("acs"), (c("p_completion") + TIE).alias("p_completion")))
add("l3_component_scores", "a_announcers", """SELECT announcer_id, CASE WHEN delivery_ratio >= 0.85 THEN 1e0 WHEN delivery_ratio >= 0.65 THEN 0.85e0 WHEN delivery_ratio >= 0.45 THEN 0.65e0 WHEN delivery_ratio >= 0.25 THEN 0.45e0 WHEN delivery_ratio >= 0 THEN 0.25e0 ELSE 0.4e0 END AS delivery,
  round(CASE WHEN median_slip_months IS NULL THEN 0.5e0 ELSE greatest(0, least(1, 1 - median_slip_months / 60)) END, 6) AS lag FROM a_announcers""", lambda a: a.select("announcer_id", cr.delivery_score(c("delivery_ratio"), P).alias("delivery"), cr.lag_score(c("median_slip_months"), P).alias("lag")))
ACT = """CASE WHEN year < announced_year OR open_year IS NULL THEN 0 WHEN year < construction_year THEN 0.15e0 WHEN year < open_year THEN 0.5e0 ELSE 0.5e0 + 0.5e0 * least(greatest((year - open_year) / 3, 0), 1) END
  * CASE WHEN year < open_year THEN pow(1.12e0, year - open_year) ELSE 1 END"""
add("l3_activation", "a_projects a_announcers", f"WITH {CRED} SELECT project_id, CAST(year AS BIGINT) AS year, round(p_completion * {ACT} + 1e-9, 6) AS weight FROM l3, range(1998, 2006) t(year)",
    lambda p, a: cr.activation(_completion(p, a), p.sparkSession.range(1998, 2006).withColumnRenamed("id", "year"), P).select("project_id", "year", (c("weight") + TIE).alias("weight")))
add("l3_pipeline_by_stage", "a_projects a_announcers", f"WITH {CRED} SELECT stage, is_public, count(*) AS n, round(sum(p_completion * capex), 2) AS expected FROM l3 GROUP BY ALL",
    lambda p, a: _completion(p, a).groupBy("stage", "is_public").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(c("p_completion") * c("capex")), 2).alias("expected")))
add("l3_announced_years", "orders", "SELECT o_orderkey, round(date_diff('day', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 900) / CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH AS DATE)) AS DOUBLE), 6) AS years FROM orders",
    lambda o: o.select("o_orderkey", cr.announced_years(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 900)).alias("years")))

# --- shocks ----------------------------------------------------------------------------------------------------
SITE = "pr AS (SELECT project_id, sx, sy FROM (SELECT p.project_id, a.x_m AS sx, a.y_m AS sy FROM a_projects p JOIN a_cells a ON a.cell = p.cell))"


def _sites(p: DataFrame, x: DataFrame) -> DataFrame:
    return p.join(x.select("cell", c("x_m").alias("sx"), c("y_m").alias("sy")), "cell").select("project_id", "sx", "sy")


DIST = "sqrt((x_m - sx) * (x_m - sx) + (y_m - sy) * (y_m - sy))"
add("l2_fields", "a_projects a_cells", f"""WITH {SITE}, d AS (SELECT cell, x_m, y_m, sx, sy, {DIST} AS d FROM a_cells, pr),
  f AS (SELECT cell, CASE WHEN d <= 500 THEN 0.2e0 WHEN d <= 1500 THEN 0.1e0 * (1 - d / 1500) ELSE 0 END AS v FROM d WHERE d <= 1500)
  SELECT cell, round(sum(v), 6) AS raw, round(greatest(-0.45e0, least(0.60e0, sum(v))), 6) AS field, sum(v) > 0.60e0 OR sum(v) < -0.45e0 AS capped FROM f GROUP BY cell""",
    lambda p, x: spatial.within(x, _sites(p, x), 1500.0, "x_m", "y_m", "sx", "sy")
    .withColumn("v", F.when(c("dist_m") <= 500, sc.field_decay("step", F.lit(0.2), c("dist_m"), 500)).otherwise(sc.field_decay("linear", F.lit(0.1), c("dist_m"), 1500)))
    .groupBy("cell").agg(F.sum("v").alias("raw")).withColumn("field", sc.clip(c("raw"), P.value("price.field_low"), P.value("price.field_high"))).withColumn("capped", c("raw") != c("field")))
add("l2_wedge", "a_projects a_cells", f"""WITH {SITE}, d AS (SELECT project_id, cell, x_m - sx AS dx, y_m - sy AS dy, 10000 - sx AS ex, 10000 - sy AS ey FROM a_cells, pr WHERE {DIST} <= 1000)
  SELECT project_id, cell, round(0.5e0 * (1 + CASE WHEN sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey) > 0 THEN (dx * ex + dy * ey) / (sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey)) ELSE 1 END), 6) AS factor FROM d""",
    lambda p, x: spatial.within(x, _sites(p, x), 1000.0, "x_m", "y_m", "sx", "sy").select("project_id", "cell", sc.wedge(c("sx"), c("sy"), c("x_m"), c("y_m"), F.lit(10000.0), F.lit(10000.0), 0.5).alias("factor")))
add("l2_nearest_site", "a_projects a_cells", f"""WITH {SITE}, one AS (SELECT sx, sy, min(project_id) AS project_id FROM pr GROUP BY ALL), d AS (SELECT cell, project_id, {DIST} AS d, row_number() OVER (PARTITION BY cell ORDER BY {DIST}, project_id) AS r FROM a_cells, one)
  SELECT cell, project_id, round(d, 6) AS dist_m FROM d WHERE r = 1""", lambda p, x: spatial.nearest_of(x, ["cell"], _sites(p, x), "project_id", "x_m", "y_m", "sx", "sy", lambda df: kept(df, "nearest")))
add("l2_households", "a_projects", "SELECT project_id, round(capex / 1000 * 0.4e0 / 1.45e0 * 0.9e0 * 0.7e0, 6) AS households, round(capex / 1000 * 0.1e0, 6) AS dormitory, CAST(CASE WHEN capex * 1.45e0 * 1.15e0 >= 200000 THEN 3 WHEN capex * 1.45e0 * 1.15e0 >= 75000 THEN 2 WHEN capex * 1.45e0 * 1.15e0 >= 25000 THEN 1 ELSE 0 END AS INTEGER) AS band FROM a_projects",
    lambda p: p.select("project_id", (c("capex") / 1000 * 0.4 / P.value("behaviour.workers_per_household") * 0.9 * 0.7).alias("households"), (c("capex") / 1000 * 0.1).alias("dormitory"),
                       sc.digitize(c("capex") * P.value("behaviour.workers_per_household") * P.value("behaviour.other_income"), P.value("behaviour.income_bounds")).alias("band")))

# --- supply, allocation, price ---------------------------------------------------------------------------------
CAP = "absorbed * pow(1.05e0, 3) * 1.1e0 * greatest(0, least(1, pow(18 / greatest(inventory, 1), 1.5e0)))"
add("l4_absorption_cap", "a_cells", f"SELECT cell, round(greatest(0, {CAP}), 6) AS cap FROM a_cells", lambda x: x.select("cell", market.absorption_cap(c("absorbed"), F.lit(3.0), F.lit(1.1), market.damping(c("inventory"), P), P).alias("cap")))
add("l4_delivery", "a_cells", f"""WITH {L0}, d AS (SELECT cell, households * 20 AS demand, jobs AS backlog, greatest(0, least(households * 20 + jobs, {CAP}, greatest(0, capacity_sqm - res_sqm))) AS delivered FROM l0e)
  SELECT cell, round(delivered, 6) AS delivered, round(least(delivered, backlog), 6) AS to_backlog, round(demand + backlog - delivered, 6) AS backlog_left FROM d""",
    lambda x: market.deliver(sub.substrate(x, P).withColumn("demand", c("households") * 20).withColumn("backlog", c("jobs")).withColumn("built", c("res_sqm"))
                             .withColumn("cap", market.absorption_cap(c("absorbed"), F.lit(3.0), F.lit(1.1), market.damping(c("inventory"), P), P))).select("cell", "delivered", "to_backlog", "backlog_left"))
add("l5_softmax", "a_cells", "WITH s AS (SELECT *, exp(lna - max(lna) OVER ()) AS e FROM a_cells) SELECT cell, round(e / sum(e) OVER () * 1000, 6) AS share FROM s",
    lambda x: market.softmax(x, "lna", "share").select("cell", (c("share") * 1000).alias("share")))
add("l5_zone_shares", "a_cells", "WITH s AS (SELECT *, exp(lna - max(lna) OVER (PARTITION BY zone)) AS e FROM a_cells) SELECT cell, round(e / sum(e) OVER (PARTITION BY zone), 6) AS share FROM s",
    lambda x: market.softmax(x, "lna", "share", ["zone"]).select("cell", "share"))


def _utility_sql(a: str) -> str:
    k = P.value(f"behaviour.logit_{a}")
    return f"""SELECT cell, round({k['access']}e0 * lna + {k['price']}e0 * ln(CASE WHEN price > 0 THEN price ELSE (SELECT quantile_cont(price, 0.5) FROM a_cells WHERE price > 0) END) + {k['amenity']}e0 * amenity - {k['disamenity']}e0 * disamenity
      + {k['agglom']}e0 * ln(households + 1) + {k['same']}e0 * CASE WHEN households > 0 THEN band_households / households ELSE 0 END, 6) AS u FROM a_cells"""


for _band in ("low", "high"):
    add(f"l5_utility_{_band}", "a_cells", _utility_sql(_band), lambda x, b=_band: market.utility(x, P.value(f"behaviour.logit_{b}"), "u").select("cell", "u"))


def _fill(x: DataFrame, rounds: int) -> DataFrame:
    state = market.softmax(x, "lna", "weight").select("cell", "weight", (c("absorbed") / 40).alias("headroom")).withColumn("active", F.lit(True)).withColumn("got", F.lit(0.0)).withColumn("rest", F.lit(1500.0))
    for _ in range(rounds):
        state = market.fill_round(state, 2.0)
    return state.select("cell", "got", "active")


FILL = "WITH w AS (SELECT cell, exp(lna - max(lna) OVER ()) AS e, absorbed / 80 AS room FROM a_cells), f0 AS (SELECT cell, e, room, TRUE AS active, 0e0 AS got, 1500e0 AS rest FROM w)"


def _fill_sql(rounds: int) -> str:
    out = FILL
    for i in range(rounds):
        out += f""", g{i} AS (SELECT *, got + CASE WHEN active THEN e / sum(CASE WHEN active THEN e ELSE 0 END) OVER () ELSE 0 END * rest AS want FROM f{i}),
          f{i + 1} AS (SELECT cell, e, room, active AND want <= room AS active, least(want, room) AS got, sum(want - least(want, room)) OVER () AS rest FROM g{i})"""
    return out + f" SELECT cell, round(got, 6) AS got, active FROM f{rounds}"


for _r in (1, 2):
    add(f"l5_fill_round{_r}", "a_cells", _fill_sql(_r), lambda x, r=_r: _fill(x, r))
SHIFT = "0.25e0 * lna / 10 + CASE WHEN households > 0 THEN ln((households + 25) / households) ELSE 0 END + greatest(-0.45e0, least(0.6e0, amenity - 0.3e0))"
add("l6_demand_shift", "a_cells", f"SELECT cell, round({SHIFT}, 6) AS shift FROM a_cells", lambda x: x.select("cell", market.demand_shift(c("lna") / 10, c("households"), F.lit(25.0), c("amenity") - 0.3, P).alias("shift")))
add("l6_supply_shift", "a_cells", "SELECT cell, round(CASE WHEN res_sqm > 0 THEN ln((res_sqm + 500) / res_sqm) ELSE 0 END, 6) AS shift FROM a_cells", lambda x: x.select("cell", market.supply_shift(c("res_sqm"), F.lit(500.0)).alias("shift")))


def _market(x: DataFrame, phi: float) -> DataFrame:
    x = sub.substrate(x, P).withColumn("d_ln_d", market.demand_shift(c("lna") / 10, c("households"), F.lit(25.0), c("amenity") - 0.3, P))
    return market.clear_market(x.withColumn("d_ln_s0", F.lit(0.01)).withColumn("quantity", c("res_sqm")).withColumn("cap", c("absorbed")), P, phi)


CLEAR = f"""{L0}, dd AS (SELECT *, {SHIFT} AS dd FROM l0e), q0 AS (SELECT *, (dd - 0.01e0) / (0.65e0 + eps) AS p0, eps * (dd - 0.01e0) / (0.65e0 + eps) + 0.01e0 AS q0,
  CASE WHEN res_sqm > 0 THEN ln((res_sqm + least(headroom_sqm, absorbed)) / res_sqm) END AS top FROM dd),
  l6 AS (SELECT *, CASE WHEN res_sqm <= 0 THEN 0 WHEN q0 > top THEN top ELSE q0 END AS d_ln_q, CASE WHEN res_sqm <= 0 THEN dd / 0.65e0 WHEN q0 > top THEN (dd - top) / 0.65e0 ELSE p0 END AS p, coalesce(q0 > top, FALSE) AS constrained FROM q0)"""
PHI = {s: P.value(f"price.phi_{s}") for s in ("base", "bull", "bear")}
for _s in PHI:
    add(f"l6_clearing_{_s}", "a_cells", f"WITH {CLEAR} SELECT cell, round(d_ln_q, 6) AS d_ln_q, round({PHI[_s]}e0 + p, 6) AS d_ln_p, constrained FROM l6", lambda x, s=_s: _market(x, PHI[s]).select("cell", "d_ln_q", "d_ln_p", "constrained"))
add("l6_flagship", "a_cells", f"WITH {CLEAR} SELECT elasticity_class, count(*) AS n, count(*) FILTER (constrained) AS n_constrained, round(avg(0.055e0 + p), 6) AS d_ln_p, round(avg(d_ln_q), 6) AS d_ln_q, round(sum(headroom_sqm), 4) AS headroom FROM l6 GROUP BY elasticity_class",
    lambda x: _market(x, PHI["base"]).groupBy("elasticity_class").agg(F.count(F.lit(1)).alias("n"), F.sum(c("constrained").cast("long")).alias("n_constrained"), F.avg("d_ln_p").alias("d_ln_p"), F.avg("d_ln_q").alias("d_ln_q"), F.round(F.sum("headroom_sqm"), 4).alias("headroom")))
add("l6_overshoot", "a_cells", "SELECT cell, round(CASE WHEN amenity / 5 > 0.03 AND zone % 9 >= 2 THEN 0.55e0 * amenity / 5 * pow(0.5e0, (zone % 9 - 2) / 3.5e0) ELSE 0 END, 6) AS overshoot FROM a_cells",
    lambda x: x.select("cell", market.overshoot(c("amenity") / 5, (c("zone") % 9 - 2).cast("double"), P).alias("overshoot")))
add("l6_overheat", "a_cells", """WITH r AS (SELECT *, lna - amenity AS residual FROM a_cells), q AS (SELECT quantile_cont(residual, 0.8) AS cut FROM r)
  SELECT cell, residual > cut AS flag_residual, rent * 12 / price < 0.018 AS flag_yield, CAST(residual > cut AS INTEGER) + coalesce(CAST(rent * 12 / price < 0.018 AS INTEGER), 0) AS score, CAST(CASE WHEN rent * 12 / price < 0.018 IS NULL THEN 1 ELSE 2 END AS INTEGER) AS score_max FROM r, q""",
    lambda x: market.overheat(x.withColumn("residual", c("lna") - c("amenity")), P).select("cell", "flag_residual", "flag_yield", "score", "score_max"))
add("l6_attribution", "a_cells", """WITH s AS (SELECT cell, lna AS full_, lna * 0.5e0 AS base_, lna - amenity / 4 AS no_a, lna - disamenity / 8 - 0.01e0 AS no_b FROM a_cells),
  r AS (SELECT cell, full_ - base_ AS total, full_ - no_a AS ra, full_ - no_b AS rb FROM s)
  SELECT cell, round(total, 6) AS total, round(total - ra - rb, 6) AS interaction, round(ra * total / greatest(ra + rb, 1e-9), 6) AS lambda_a, round(rb * total / greatest(ra + rb, 1e-9), 6) AS lambda_b FROM r""",
    lambda x: market.attribute(x.select("cell", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), v.alias("value")) for n, v in (("full", c("lna")), ("base", c("lna") * 0.5), ("no_a", c("lna") - c("amenity") / 4), ("no_b", c("lna") - c("disamenity") / 8 - 0.01))])).alias("s")).select("cell", "s.scenario", "s.value"), "cell", ["a", "b"], P))
add("l6_yield_and_units", "a_cells", "SELECT cell, round(rent * 12 / price, 6) AS yield, round(price / (0.3048e0 * 0.3048e0), 6) AS per_sqm FROM a_cells", lambda x: x.select("cell", sc.gross_yield(c("rent"), c("price")).alias("yield"), sc.per_sqm(c("price")).alias("per_sqm")))

# --- ensembles -------------------------------------------------------------------------------------------------
add("mc_quantiles", "a_draws", "SELECT cell, q AS quantile, round(CASE q WHEN 0.1 THEN quantile_cont(value, 0.1) WHEN 0.5 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.9) END, 6) AS value FROM a_draws, (VALUES (0.1e0), (0.5e0), (0.9e0)) t(q) GROUP BY cell, q",
    lambda d: market.ensemble_quantiles(d, ["cell"], "value", [0.1, 0.5, 0.9]))
add("mc_outperform", "a_draws", "WITH k AS (SELECT draw, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.9) AS d FROM a_draws GROUP BY draw) SELECT cell, round(avg(CASE WHEN value > m THEN 1e0 ELSE 0 END), 6) AS p_outperform, round(avg(CASE WHEN value >= d THEN 1e0 ELSE 0 END), 6) AS p_top_decile FROM a_draws JOIN k USING (draw) GROUP BY cell",
    lambda d: market.outperformance(d, "draw", "cell", "value"))
add("mc_band", "a_draws", "SELECT cell, round(quantile_cont(value, 0.1), 6) AS p_low, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p_high, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS width FROM a_draws GROUP BY cell",
    lambda d: ms.bands(d, ["cell"], "value"))
add("mc_p50_converged", "a_draws", "WITH h AS (SELECT cell, quantile_cont(value, 0.5) FILTER (draw < 6) AS a, quantile_cont(value, 0.5) AS b FROM a_draws GROUP BY cell) SELECT round(max(abs(a - b) / abs(b)), 6) AS worst, max(abs(a - b) / abs(b)) <= 0.02 AS converged FROM h",
    lambda d: ms.converged(d, "cell", "value", "draw", 6, 0.02))

# --- shared measures -------------------------------------------------------------------------------------------
add("gini_by_zone", "a_cells", """WITH r AS (SELECT zone, mean_parcel_sqm AS v, row_number() OVER (PARTITION BY zone ORDER BY mean_parcel_sqm) AS i FROM a_cells WHERE mean_parcel_sqm IS NOT NULL)
  SELECT zone, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(CASE WHEN sum(v) = 0 THEN 0 ELSE 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / CAST(count(*) AS DOUBLE) END, 6) AS gini FROM r GROUP BY zone""",
    lambda x: ms.gini(x, "zone", "mean_parcel_sqm"))
add("spearman", "a_cells", """WITH v AS (SELECT price, rent FROM a_cells WHERE price IS NOT NULL AND rent IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2 AS a, rank() OVER (ORDER BY rent) + (count(*) OVER (PARTITION BY rent) - 1) / 2 AS b FROM v)
  SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""", lambda x: ms.spearman(x, "price", "rent"))
add("latest_as_of", "a_events", "SELECT project, event_type, max(ts) AS ts FROM (SELECT *, rank() OVER (PARTITION BY project ORDER BY ts DESC, event_type DESC) AS r FROM a_events WHERE ts <= TIMESTAMP '2024-01-20') WHERE r = 1 GROUP BY ALL",
    lambda e: ms.latest_as_of(e, ["project"], "ts", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"), ["event_type"]))
add("state_ratchet", "a_events", "SELECT event_id, CAST(CASE WHEN state_rank IS NOT NULL THEN max(state_rank) OVER (PARTITION BY project ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS INTEGER) AS ratcheted FROM a_events",
    lambda e: ms.ratchet(e, "project", ["ts", "event_id"], "state_rank").select("event_id", "ratcheted"))
add("yearly_change", "a_history", "SELECT cell, year, round(coalesce(price - lag(price) OVER (PARTITION BY cell ORDER BY year), 0), 6) AS change FROM a_history", lambda h: ms.yearly_change(h, "cell", "year", "price", "change").select("cell", "year", "change"))
add("light_outliers", "a_history", "WITH q AS (SELECT year, quantile_cont(light, 0.95) AS cut FROM a_history GROUP BY year) SELECT cell, year, round(CASE WHEN light >= 5 THEN least(light, cut) END, 6) AS capped FROM a_history JOIN q USING (year)",
    lambda h: ms.percentile_cap(h, ["year"], "light", 0.95, 5.0).select("cell", "year", "capped"))
add("annual_median", "lineitem", "SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS year, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY ALL", lambda h: ms.annual_median(h, "l_partkey", "l_shipdate", "l_quantity"))
add("monthly_mean", "lineitem", "SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL", lambda h: ms.monthly_mean(h, "l_partkey", "l_shipdate", "l_quantity"))
add("landcover_majority", "a_cells", """WITH w AS (SELECT zone, land_type, sum(area_sqm) AS w FROM a_cells GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY w DESC, land_type) AS r, sum(w) OVER (PARTITION BY zone) AS t, count(*) OVER (PARTITION BY zone) AS n FROM w)
  SELECT zone, land_type AS majority, round(w / t, 6) AS share, n AS n_classes FROM r WHERE r = 1""", lambda x: ms.majority(x, "zone", "land_type", "area_sqm"))
add("landcover_fractions", "a_cells", "WITH w AS (SELECT zone, land_type, sum(area_sqm) AS w FROM a_cells GROUP BY ALL) SELECT zone, land_type, round(w / sum(w) OVER (PARTITION BY zone), 6) AS frac FROM w", lambda x: ms.fractions(x, "zone", "land_type", "area_sqm"))
add("zonal_statistics", "a_cells", "SELECT zone, round(sum(slope_pct * area_sqm) / sum(area_sqm), 6) AS z_mean, round(sum(slope_pct * area_sqm), 4) AS z_sum, round(sum(area_sqm), 4) AS z_count, max(slope_pct) AS z_max FROM a_cells GROUP BY zone",
    lambda x: ms.zonal(x, "zone", "slope_pct", "area_sqm").select("zone", "z_mean", F.round("z_sum", 4).alias("z_sum"), F.round("z_count", 4).alias("z_count"), "z_max"))
add("coverage_report", "a_cells", """WITH l AS (SELECT cell, 'price' AS "column", price IS NOT NULL AS t FROM a_cells UNION ALL SELECT cell, 'rent', rent IS NOT NULL FROM a_cells UNION ALL SELECT cell, 'mean_parcel_sqm', mean_parcel_sqm IS NOT NULL FROM a_cells),
  m AS (SELECT *, "column" = 'price' AND cell IN (SELECT cell FROM a_cells WHERE brand = 'Brand#3') AS i FROM l)
  SELECT "column", round(avg(CASE WHEN t AND NOT i THEN 1e0 ELSE 0 END), 6) AS real, round(avg(CASE WHEN t AND i THEN 1e0 ELSE 0 END), 6) AS imputed, round(avg(CASE WHEN NOT t THEN 1e0 ELSE 0 END), 6) AS missing, avg(CASE WHEN t AND NOT i THEN 1e0 ELSE 0 END) >= 0.85 AS passes FROM m GROUP BY "column" """,
    lambda x: ms.coverage(x, "cell", ["price", "rent", "mean_parcel_sqm"], x.filter("brand = 'Brand#3'").select("cell", F.lit("price").alias("column")), 0.85))
add("data_confidence", "lineitem", "SELECT l_partkey, round(greatest(0.1e0, least(1, 0.95e0 - sum(CASE WHEN l_returnflag = 'N' THEN 0.03e0 WHEN l_linestatus = 'F' THEN 0.02e0 ELSE 0.01e0 END))), 6) AS data_conf FROM lineitem GROUP BY l_partkey",
    lambda h: ms.confidence(h.withColumn("w", F.when(c("l_linestatus") == "F", 0.02).otherwise(0.01)), "l_partkey", "w", 0.95, 0.1, c("l_returnflag") == "N", 0.03))
add("imputation_index", "lineitem", "SELECT l_partkey, bool_or(l_linestatus = 'F') AS imputed, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS methods FROM lineitem GROUP BY l_partkey",
    lambda h: ms.ledger_index(h.withColumn("f", c("l_linestatus") == "F"), ["l_partkey"], "f", "l_returnflag"))
add("imputation_long", "a_cells", """SELECT cell, 'price' AS "column" FROM a_cells WHERE price IS NULL UNION ALL SELECT cell, 'rent' FROM a_cells WHERE rent IS NULL""",
    lambda x: x.select("cell", F.explode(F.array(*[F.struct(F.lit(k).alias("column"), c(k).isNull().alias("gone")) for k in ("price", "rent")])).alias("f")).filter("f.gone").select("cell", "f.column"))
add("smeared_price", "a_cells", """WITH p AS (SELECT cell AS point, x_m AS px, y_m AS py, price FROM a_cells WHERE price IS NOT NULL), d AS (SELECT a.cell, p.price, (x_m - px) * (x_m - px) + (y_m - py) * (y_m - py) AS d2 FROM a_cells a, p)
  SELECT cell, round(sum(exp(-d2 / (2 * 800e0 * 800e0)) * price) / sum(exp(-d2 / (2 * 800e0 * 800e0))), 6) AS smeared, count(*) AS n_points FROM d WHERE sqrt(d2) <= 2000 GROUP BY cell""",
    lambda x: spatial.gaussian_smear(spatial.within(x.drop("price"), x.filter("price IS NOT NULL").select(c("cell").alias("point"), c("x_m").alias("px"), c("y_m").alias("py"), "price"), 2000.0, "x_m", "y_m", "px", "py"), "cell", "price", 800.0))


def _cut(df: DataFrame) -> DataFrame:
    return kept(df, "round")


def _knn(x: DataFrame) -> DataFrame:
    return spatial.knn_weights(spatial.knn(x, "cell", "other", 4, "x_m", "y_m", 1500.0, _cut), "cell", "other", 4)


KNN = """d AS (SELECT a.cell, b.cell AS other, sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) AS d FROM a_cells a, a_cells b WHERE a.cell <> b.cell),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d, other) AS r FROM d) WHERE r <= 4), w AS (SELECT cell, other, 1e0 / count(*) OVER (PARTITION BY cell) AS weight FROM k)"""
add("knn_weights", "a_cells", f"WITH {KNN} SELECT cell, other, round(weight, 6) AS weight FROM w", lambda x: _knn(x).select("cell", "other", "weight"))
add("morans_i", "a_cells", f"""WITH {KNN}, u AS (SELECT cell, amenity - avg(amenity) OVER () AS u FROM a_cells), t AS (SELECT sum(weight * p.u * q.u) AS t, sum(weight) AS s0 FROM w JOIN u p ON p.cell = w.cell JOIN u q ON q.cell = w.other), b AS (SELECT sum(u * u) AS b, count(*) AS n FROM u)
  SELECT round(n / s0 * t / b, 6) AS moran_i FROM t, b""", lambda x: spatial.morans_i(_knn(x), "cell", "other", x, "amenity"))

# --- ingest ----------------------------------------------------------------------------------------------------
add("price_blend", "a_cells", "SELECT cell, round(CASE WHEN price IS NOT NULL AND rent IS NOT NULL THEN 0.6e0 * price + 0.4e0 * rent * 1.2e0 ELSE coalesce(price, rent * 1.2e0) END, 6) AS price FROM a_cells", lambda x: x.select("cell", ms.blend(c("price"), c("rent"), F.lit(1.2), 0.6).alias("price")))
add("rent_fallback", "a_cells", "SELECT cell, round(CASE WHEN rent IS NULL AND count(rent) OVER z >= 3 THEN quantile_cont(rent, 0.5) OVER z ELSE rent END, 6) AS filled, rent IS NULL AND count(rent) OVER z >= 3 AS was_filled FROM a_cells WINDOW z AS (PARTITION BY zone)",
    lambda x: ms.parent_median(x, "rent", "zone", 3).select("cell", "filled", "was_filled"))
add("promoter_record", "orders", """SELECT o_custkey, count(DISTINCT o_orderkey) AS n_projects, round(sum(o_totalprice), 2) AS planned, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS done, quantile_cont(o_orderkey % 30, 0.5) AS median_slip,
  round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS ratio FROM orders GROUP BY o_custkey""",
    lambda o: ms.delivery_record(o.withColumn("done", F.when(c("o_orderstatus") == "F", c("o_totalprice")).otherwise(0.0)).withColumn("slip", (c("o_orderkey") % 30).cast("double")), "o_custkey", "o_orderkey", "o_totalprice", "done", "slip").withColumn("planned", F.round("planned", 2)).withColumn("done", F.round("done", 2)))
add("quarter_end", "orders", "SELECT o_orderkey, make_date(CAST(year(o_orderdate) AS BIGINT), CAST(quarter(o_orderdate) * 3 AS BIGINT), 1) AS month FROM orders",
    lambda o: o.select("o_orderkey", sc.quarter_end(F.concat(F.lit("FY"), F.year("o_orderdate").cast("string"), F.lit(" Q"), F.quarter("o_orderdate").cast("string"))).alias("month")))
add("storeys", "a_cells", "SELECT cell, greatest(1, coalesce(CASE WHEN cell % 3 = 0 THEN round_even(slope_pct / 3.2e0, 0) END, 2 + zone % 3)) AS storeys, round(least(1, res_sqm / area_sqm), 6) AS built FROM a_cells",
    lambda x: x.select("cell", cc.storeys(F.when(c("cell") % 3 == 0, c("slope_pct")), 2 + c("zone") % 3).alias("storeys"), sc.clip(c("res_sqm") / c("area_sqm"), 0.0, 1.0).alias("built")))
add("population_growth", "a_cells", "SELECT cell, round(households * 4 * pow(1.021e0, 13), 6) AS population FROM a_cells", lambda x: x.select("cell", ingest.population_by(c("households") * 4, 0.021, 13).alias("population")))
add("guidance_units", "a_cells", "SELECT CAST(cell AS VARCHAR) AS locality_id, CAST(zone AS VARCHAR) AS sro_code, CAST(NULL AS BIGINT) AS effective_year, round(raw_price / 9, 6) AS guidance_inr_sqft FROM a_cells",
    lambda x: adapter_for("AP").guidance(x.select(c("cell").alias("locality_id"), c("zone").alias("sro_code"), c("raw_price").alias("guidance_inr_sqyd"))))
add("slope_from_grid", "a_cells", """WITH g AS (SELECT cell % 40 AS col, CAST(floor(cell / 40) AS BIGINT) AS row, cell, raw_price AS z FROM a_cells),
  d AS (SELECT cell, CASE WHEN lead(z) OVER r IS NULL AND lag(z) OVER r IS NULL THEN 0 WHEN lead(z) OVER r IS NULL THEN z - lag(z) OVER r WHEN lag(z) OVER r IS NULL THEN lead(z) OVER r - z ELSE (lead(z) OVER r - lag(z) OVER r) / 2 END / 500 AS dx,
    CASE WHEN lead(z) OVER q IS NULL AND lag(z) OVER q IS NULL THEN 0 WHEN lead(z) OVER q IS NULL THEN z - lag(z) OVER q WHEN lag(z) OVER q IS NULL THEN lead(z) OVER q - z ELSE (lead(z) OVER q - lag(z) OVER q) / 2 END / 433 AS dy FROM g WINDOW r AS (PARTITION BY row ORDER BY col), q AS (PARTITION BY col ORDER BY row))
  SELECT cell, round(100 * sqrt(dx * dx + dy * dy), 6) AS slope_pct FROM d""",
    lambda x: ingest.slope_percent(x.select("cell", (c("cell") % 40).alias("col"), F.floor(c("cell") / 40).alias("row"), c("raw_price").alias("z")), "row", "col", "z", 500.0, 433.0).select("cell", "slope_pct"))

# --- backtest --------------------------------------------------------------------------------------------------
add("bt_stage_rollback", "a_events", "SELECT project, event_type AS stage FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_type DESC) AS r FROM a_events WHERE ts <= TIMESTAMP '2024-01-10' AND event_type <> 'error') WHERE r = 1",
    lambda e: ms.latest_as_of(e.filter("event_type <> 'error'"), ["project"], "ts", F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"), ["event_type"]).select("project", c("event_type").alias("stage")))
add("bt_cells_at_t0", "a_cells a_history", "SELECT a.cell, round(coalesce(h.price, a.price), 6) AS price FROM a_cells a LEFT JOIN (SELECT * FROM a_history WHERE year = 1998) h USING (cell)",
    lambda x, h: x.select("cell", c("price").alias("now")).join(h.filter("year = 1998").select("cell", "price"), "cell", "left").select("cell", F.coalesce("price", "now").alias("price")))
GROW = "greatest(-0.2e0, least(0.5e0, pow(b / a, 1e0 / 3) - 1))"
add("bt_momentum", "a_history", f"""WITH o AS (SELECT cell, avg(price) FILTER (year = 1996) AS a, avg(price) FILTER (year = 1999) AS b FROM a_history GROUP BY cell), w AS (SELECT avg(price) FILTER (year = 1996) AS a, avg(price) FILTER (year = 1999) AS b FROM a_history)
  SELECT cell, round(coalesce(CASE WHEN a > 0 AND b > 0 THEN {GROW} END, (SELECT {GROW} FROM w)), 6) AS cagr, a IS NULL OR b IS NULL AS fallback FROM o""", lambda h: ms.cagr(h, "cell", "year", "price", 1996, 1999, -0.2, 0.5))
add("bt_city_growth", "a_history", f"WITH w AS (SELECT avg(price) FILTER (year = 1996) AS a, avg(price) FILTER (year = 1999) AS b FROM a_history) SELECT round({GROW}, 6) AS cagr FROM w",
    lambda h: ms.city_growth(h, "year", "price", 1996, 1999, -0.2, 0.5))
add("bt_distance_fit", "a_cells", "WITH v AS (SELECT ln(price) AS y, ln(1 + sqrt((x_m - 10000) * (x_m - 10000) + (y_m - 10000) * (y_m - 10000))) AS x FROM a_cells WHERE price > 0) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS n FROM v",
    lambda x: x.filter("price > 0").select(F.ln("price").alias("y"), F.ln(1 + F.hypot(c("x_m") - 10000, c("y_m") - 10000)).alias("x")).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count(F.lit(1)).alias("n")))
add("bt_announcement_premium", "a_projects a_cells", f"WITH {SITE}, d AS (SELECT cell, {DIST} AS d FROM a_cells, pr) SELECT cell, round(sum(ln(1 + CASE WHEN d <= 500 THEN 0.1e0 WHEN d <= 1000 THEN 0.05e0 ELSE 0.02e0 END)), 6) AS premium FROM d WHERE d <= 2000 GROUP BY cell",
    lambda p, x: bt.announcement_premium(x, _sites(p, x), [[500, 0.1], [1000, 0.05]], 0.02, 2000.0))
add("bt_greedy_fill", "a_cells", """SELECT cell, round(greatest(0, least(absorbed, 5000 - coalesce(sum(absorbed) OVER (PARTITION BY zone ORDER BY lna DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))), 6) AS take FROM a_cells""",
    lambda x: market.running_fill(x, "lna", "cell", "absorbed", 5000.0, ["zone"]).select("cell", "take"))
add("bt_top_k", "a_cells", "WITH t AS (SELECT lna FROM a_cells ORDER BY amenity DESC, cell LIMIT 50) SELECT round(avg(CASE WHEN lna >= (SELECT quantile_cont(lna, 0.9) FROM a_cells) THEN 1e0 ELSE 0 END), 6) AS precision, count(*) AS k FROM t", lambda x: ms.top_k_precision(x, "cell", "amenity", "lna", 50, 0.9))
add("bt_band_coverage", "a_cells", "SELECT round(avg(CASE WHEN raw_price BETWEEN 920 AND 980 + slope_pct THEN 1e0 ELSE 0 END), 6) AS coverage, count(*) AS n FROM a_cells", lambda x: ms.band_coverage(x.withColumn("lo", F.lit(920.0)).withColumn("hi", 980 + c("slope_pct")), "raw_price", "lo", "hi"))
add("bt_mape", "a_cells", "SELECT round(avg(abs((amenity - lna) / lna)), 6) AS mape, count(*) AS n FROM a_cells WHERE abs(lna) >= 0.05", lambda x: ms.mape(x, "amenity", "lna", 0.05))
add("bt_zone_mean", "a_cells", "SELECT zone, round(avg(price), 6) AS price, bool_or(price IS NOT NULL) AS priced FROM a_cells GROUP BY zone", lambda x: ms.zone_means(x, "zone", "price"))
add("bt_price_test", "a_cells", "WITH z AS (SELECT zone, bool_or(rent IS NOT NULL AND cell % 3 = 0) AS priced FROM a_cells GROUP BY zone) SELECT round(avg(CASE WHEN priced THEN 1e0 ELSE 0 END), 6) AS share, avg(CASE WHEN priced THEN 1e0 ELSE 0 END) >= 0.3 AS enabled FROM z",
    lambda x: ms.price_test(x.withColumn("rent", F.when(c("cell") % 3 == 0, c("rent"))), "zone", "rent", 0.3))
add("bt_no_lookahead", "a_history", "SELECT count(*) FILTER (year > 1999) AS n_after, max(year) AS last FROM a_history", lambda h: h.agg(F.count_if(c("year") > 1999).alias("n_after"), F.max("year").alias("last")))
# --- satellite -------------------------------------------------------------------------------------------------
add("sat_composite", "a_events", """WITH p AS (SELECT project, CAST(date_trunc('week', ts) AS DATE) AS month, pixel, quantile_cont(CASE WHEN clear THEN value END, 0.5) AS v, max(CASE WHEN clear THEN 1 ELSE 0 END) AS k FROM a_events GROUP BY ALL),
  m AS (SELECT project, month, avg(v) AS value, avg(k) AS clear FROM p GROUP BY ALL) SELECT project, month, round(value, 6) AS value, round(clear, 6) AS clear FROM m WHERE clear >= 0.6""",
    lambda e: ms.composites(e, "project", F.to_date(F.date_trunc("week", "ts")), "pixel", "value", c("clear"), 0.6))
add("sat_indices", "a_cells", "SELECT cell, round(CASE WHEN lna + amenity <> 0 THEN (lna - amenity) / (lna + amenity) END, 6) AS ndvi, round(CASE WHEN lna + amenity + disamenity + builtup_frac <> 0 THEN ((lna + amenity) - (disamenity + builtup_frac)) / (lna + amenity + disamenity + builtup_frac) END, 6) AS bsi FROM a_cells",
    lambda x: x.select("cell", sc.normalized_difference(c("lna"), c("amenity")).alias("ndvi"), sc.bare_soil(c("builtup_frac"), c("amenity"), c("disamenity"), c("lna")).alias("bsi")))
add("sat_priority", "a_projects", "SELECT project_id, row_number() OVER (ORDER BY capex DESC, project_id) AS rank FROM a_projects ORDER BY capex DESC, project_id LIMIT 25", lambda p: ms.priority_tier(p, "capex", "project_id", 25))


add("store_read_where", "a_cells", "SELECT cell FROM a_cells WHERE zone IN (3, 5, 8) AND price IS NULL", lambda x: ms.read_where(x, zone=[3, 5, 8], price=None).select("cell"))
add("store_upsert", "a_cells", "SELECT cell, CASE WHEN brand = 'Brand#3' THEN zone + 1000 ELSE zone END AS zone FROM a_cells", lambda x: ms.upsert(x.select("cell", "zone"), x.filter("brand = 'Brand#3'").select("cell", (c("zone") + 1000).alias("zone")), ["cell"]))
CHECKED = Table("checked", ("brand",), (Col("cell", "bigint"), Col("builtup_frac", "double", low=0, high=0.9), Col("price", "double", low=0), Col("brand", "string"), Col("rent", "double", nullable=True, low=2)))
add("schema_violations", "a_cells", """SELECT 'builtup_frac' AS "check", count(*) AS n FROM a_cells WHERE NOT coalesce(builtup_frac BETWEEN 0 AND 0.9, FALSE) UNION ALL SELECT 'price', count(*) FROM a_cells WHERE NOT coalesce(price >= 0, FALSE)
  UNION ALL SELECT 'rent', count(*) FROM a_cells WHERE rent < 2 UNION ALL SELECT 'key', count(*) FROM (SELECT brand FROM a_cells GROUP BY brand HAVING count(*) > 1)""",
    lambda x: CHECKED.counts(x.select("cell", "builtup_frac", "price", "brand", "rent")))
add("review_queue", "conversations", """SELECT conv_id, turn, CASE WHEN length(text) % 100 >= 60 AND turn <> 0 AND role <> 'system' THEN 'auto_applied' ELSE 'pending' END AS decision FROM conversations""",
    lambda v: ms.queue_decisions(v.withColumn("confidence", F.length("text") % 100 / 100.0).withColumn("is_new", c("turn") == 0).withColumn("is_stage_change", c("role") == "system"), 0.6).select("conv_id", "turn", "decision"))
add("report_references", "documents", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\[([A-Za-z0-9_.]+)\\]', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS clean FROM documents", lambda d: d.select("doc_id", govern.stripped(c("text")).alias("clean")))
EXACT, PATTERNS = {"mit": "permissive", "isc": "permissive"}, [("gnu (lesser|general|affero)", "copyleft"), ("apache|mit license|bsd", "permissive"), ("cc by", "data")]
add("licence_class", "documents", """SELECT doc_id, CASE WHEN text IS NULL OR trim(lower(text)) = '' THEN 'unknown' WHEN trim(lower(text)) IN ('mit', 'isc') THEN 'permissive' WHEN regexp_matches(lower(text), 'gnu (lesser|general|affero)') THEN 'copyleft'
  WHEN regexp_matches(lower(text), 'apache|mit license|bsd') THEN 'permissive' WHEN regexp_matches(lower(text), 'cc by') THEN 'data' ELSE 'unknown' END AS class FROM documents""", lambda d: d.select("doc_id", ms.licence_class(c("text"), EXACT, PATTERNS).alias("class")))
add("blocks_rollup", "a_cells", "SELECT land_type, brand, count(*) AS n, round(avg(price), 6) AS price FROM a_cells GROUP BY ROLLUP (land_type, brand)", lambda x: x.rollup("land_type", "brand").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("price")))

# --- more joins, ledgers and registers -------------------------------------------------------------------------
add("merge_replace", "a_cells a_history", "SELECT a.cell, round(h.price, 6) AS price FROM a_cells a LEFT JOIN (SELECT cell, price FROM a_history WHERE year = 1997) h USING (cell)",
    lambda x, h: ingest.merge(x.select("cell", "price"), h.filter("year = 1997").select("cell", "price"), "cell"))
add("outer_merge", "a_cells a_history", "SELECT a.cell, round(slope_pct, 6) AS slope_pct, round(light, 6) AS light FROM (SELECT cell FROM a_cells) a LEFT JOIN (SELECT coalesce(x.cell, h.cell) AS cell, slope_pct, light FROM (SELECT * FROM a_cells WHERE util_water = 0) x FULL JOIN (SELECT * FROM a_history WHERE year = 1999) h ON x.cell = h.cell) m USING (cell)",
    lambda x, h: ingest.outer_merge(x.filter("util_water = 0").select("cell", "slope_pct"), h.filter("year = 1999").select("cell", "light"), x, "cell"))
add("masked_shares", "a_cells", "WITH s AS (SELECT *, CASE WHEN price IS NOT NULL THEN lna END AS u FROM a_cells) SELECT cell, round(coalesce(exp(u - max(u) OVER (PARTITION BY zone)), 0) / sum(exp(u - max_u)) OVER (PARTITION BY zone), 6) AS share FROM (SELECT *, max(u) OVER (PARTITION BY zone) AS max_u FROM s)",
    lambda x: market.softmax(x.withColumn("u", F.when(c("price").isNotNull(), c("lna"))), "u", "share", ["zone"]).select("cell", "share"))
add("firm_shares", "a_cells", "WITH f AS (SELECT *, exp(0.5e0 * lna - 0.04e0 * slope_pct) AS e FROM a_cells WHERE util_power = 1) SELECT cell, round(1000 * e / sum(e) OVER (), 6) AS jobs FROM f",
    lambda x: market.firm_shares(x, {"lna": 0.5, "slope_pct": -0.04}, 1000.0, c("util_power") == 1))
add("supply_pipeline", "a_projects", "SELECT cell, CAST(floor(open_year) AS BIGINT) AS year, count(*) AS n, round(sum(capex), 2) AS capex FROM a_projects WHERE open_year IS NOT NULL GROUP BY ALL",
    lambda p: ms.forward_supply(p, "cell", "open_year", "capex").withColumn("capex", F.round("capex", 2)))
add("absorption_observed", "orders", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, count(*) AS units, round(avg(o_totalprice) + 1e-7, 4) AS price FROM orders GROUP BY ALL",
    lambda o: ms.quarterly(o, "o_orderdate", "o_totalprice").withColumn("price", F.round(c("price") + 100 * TIE, 4)))
add("effects_by_year", "a_projects", "SELECT cell, round(sum(capex) / 1000, 6) AS delta, round(greatest(0, 5000 - sum(capex) / 1000), 6) AS capacity FROM a_projects WHERE announced_year = 1997 GROUP BY cell",
    lambda p: market.effects_of_year(p.select("cell", c("announced_year").alias("start_year"), (c("capex") / 1000).alias("delta")), 1997, F.lit(5000.0)))
add("delivery_split", "a_cells", "SELECT cell, round(CASE WHEN res_sqm + com_sqm > 0 THEN 100 * res_sqm / (res_sqm + com_sqm) ELSE 100 END, 6) AS res, round(CASE WHEN res_sqm + com_sqm > 0 THEN 100 * com_sqm / (res_sqm + com_sqm) ELSE 0 END, 6) AS com FROM a_cells",
    lambda x: x.select("cell", *[v.alias(n) for n, v in zip(("res", "com"), market.delivery_split(F.lit(100.0), c("res_sqm"), c("com_sqm")))]))
add("pivot_band", "a_draws", "SELECT cell, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.9), 6) AS q90 FROM a_draws GROUP BY cell",
    lambda d: ms.wide_band(market.ensemble_quantiles(d, ["cell"], "value", [0.1, 0.9]), ["cell"], {0.1: "q10", 0.9: "q90"}))
add("unpivot_factors", "a_cells", "SELECT cell, 'amenity' AS factor, round(amenity, 6) AS value FROM a_cells UNION ALL SELECT cell, 'price', round(price, 6) FROM a_cells", lambda x: ms.long_loadings(x, ["cell"], ["amenity", "price"]))
add("broker_median", "lineitem", "SELECT l_partkey, round(quantile_cont(l_extendedprice / l_quantity, 0.5) + 1e-9, 6) AS price, count(*) AS n FROM lineitem GROUP BY l_partkey", lambda h: ms.panel_median(h, "l_partkey", c("l_extendedprice") / c("l_quantity"), 1).withColumn("price", c("price") + TIE))
add("dead_pipeline_share", "a_projects", "SELECT count(*) FILTER (abandoned) AS n_dead, round(avg(CASE WHEN abandoned THEN 1e0 ELSE 0 END), 6) AS share, count(*) FILTER (abandoned) >= 1 AND avg(CASE WHEN abandoned THEN 1e0 ELSE 0 END) >= 0.05 AS ok FROM a_projects",
    lambda p: ms.dead_share(p, "abandoned", 1, 0.05))
add("terminal_outcome", "a_events", "SELECT project, event_type FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_type DESC) AS r FROM a_events WHERE event_type IN ('purchase', 'error')) WHERE r = 1",
    lambda e: ms.outcomes(e, "project", "ts", "event_type", ["purchase", "error"]))
add("clipped_dates", "orders", "SELECT o_orderkey, CAST(CASE WHEN year(o_orderdate) <= 1998 THEN o_orderdate ELSE TIMESTAMP '1998-12-31' END AS DATE) AS d FROM orders", lambda o: o.select("o_orderkey", ms.clipped_date(c("o_orderdate"), 1998).alias("d")))
add("registry_problems", "a_projects", """SELECT project_id, unnest(list_filter([CASE WHEN stage NOT IN ('announced', 'funded', 'construction') THEN 'stage' END, CASE WHEN NOT is_public AND commitment_form NOT IN ('verbal', 'board_approved') THEN 'commitment' END, CASE WHEN NOT coalesce(capex > 0, FALSE) THEN 'size' END,
    CASE WHEN open_year < announced_year THEN 'dates' END, CASE WHEN claims_construction AND physical_state = 'none' THEN 'not_seen' END, CASE WHEN project_id % 37 = 0 OR project_id % 53 = 0 THEN 'no_source' END,
    CASE WHEN stage <> 'announced' AND project_id % 6 < 2 THEN 'unsigned' END], lambda x: x IS NOT NULL)) AS problem FROM a_projects""",
    lambda p: ingest.registry_problems(p.withColumn("source_urls", F.when(c("project_id") % 37 == 0, F.array().cast("array<string>")).when(c("project_id") % 53 != 0, F.array(c("project_id").cast("string")))), ["announced", "funded", "construction"], ["verbal", "board_approved"],
                                       p.filter("project_id % 6 <> 0").select("project_id", F.lit("stage").alias("field"), F.when(c("project_id") % 6 == 1, "model-1").otherwise("reviewer").alias("changed_by"))))
add("district_total", "a_cells", "SELECT zone, round(sum(households * 4), 6) AS population, abs(sum(households * 4) - 700) <= 0.5e0 * 700 AS within FROM a_cells GROUP BY zone", lambda x: ms.district_totals(x, "zone", c("households") * 4, 700.0, 0.5))
add("band_reliability", "a_draws", "WITH q AS (SELECT cell, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b FROM a_draws WHERE draw > 0 GROUP BY cell) SELECT round(avg(CASE WHEN value BETWEEN a AND b THEN 1e0 ELSE 0 END), 6) AS coverage, count(*) AS n FROM a_draws JOIN q USING (cell) WHERE draw = 0",
    lambda d: ms.band_coverage(d.filter("draw = 0").join(d.filter("draw > 0").groupBy("cell").agg(F.percentile("value", F.lit(0.1)).alias("lo"), F.percentile("value", F.lit(0.9)).alias("hi")), "cell"), "value", "lo", "hi"))
add("imputed_flags", "a_cells", "SELECT cell, price IS NULL OR rent IS NULL AS flag, CASE WHEN price IS NULL THEN 'median' WHEN rent IS NULL THEN 'parent' END AS method FROM a_cells",
    lambda x: ingest.mark_imputed(ingest.mark_imputed(x, "v", c("price").isNull(), "median"), "v", c("rent").isNull(), "parent").select("cell", c("v__imputed").alias("flag"), c("v__method").alias("method")))
add("physical_state", "a_cells", "SELECT cell, CASE WHEN amenity >= 0.5 AND lna >= 1 THEN 'operating' WHEN amenity >= 0.5 THEN 'structure' WHEN -disamenity <= -0.4 AND builtup_frac >= 0.3 THEN 'earthworks' WHEN -disamenity <= -0.4 THEN 'cleared' ELSE 'none' END AS state FROM a_cells",
    lambda x: x.select("cell", ingest.physical_state(-c("disamenity"), c("amenity"), c("builtup_frac"), c("lna"), {"built": 0.5, "light": 1.0, "green": 0.4, "soil": 0.3}).alias("state")))
