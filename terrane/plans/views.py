"""Domain tables as views over the synthetic star schema, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables and views it reads, SQL). Each column is arithmetic on keys: no randomness, no hashes.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "a_cells": (("part",), """
        SELECT p_partkey AS cell, CAST(floor(p_partkey / 7) AS BIGINT) AS zone,
          CAST(p_partkey % 40 AS DOUBLE) * 500e0 + CAST(floor(p_partkey / 40) AS BIGINT) % 2 * 250e0 AS x_m, floor(p_partkey / 40) * 433e0 AS y_m,
          100000e0 + 200e0 * p_size AS area_sqm, CAST(p_partkey % 25 AS DOUBLE) AS slope_pct, (p_partkey % 96) / 100e0 AS builtup_frac,
          CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE (p_partkey % 61) / 100e0 END AS undevelopable_frac, 1e0 + (p_size % 26) / 10e0 AS permitted_far,
          CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey % 97) * 100e0 END AS mean_parcel_sqm,
          p_partkey % 2 AS util_water, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS util_sewer, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS util_power,
          (p_partkey % 96) * 500e0 AS res_sqm, (p_partkey % 96) * 150e0 AS com_sqm,
          CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice * (1 + p_partkey % 3) / 1000e0 END AS rent,
          CAST(p_partkey % 50 AS DOUBLE) * 10e0 AS households, CAST(p_partkey % 50 AS DOUBLE) * 4e0 AS band_households, (p_partkey % 37) * 12e0 AS jobs,
          CAST(p_partkey % 4 AS DOUBLE) AS retail_poi, CAST(p_partkey % 3 AS DOUBLE) AS education_poi, CAST(p_partkey % 2 AS DOUBLE) AS health_poi,
          CASE WHEN p_partkey % 6 = 0 THEN 300e0 ELSE 0e0 END AS school_seats, CASE WHEN p_partkey % 10 = 0 THEN 80e0 ELSE 0e0 END AS beds,
          (p_partkey % 13) / 13e0 AS amenity, (p_partkey % 17) / 17e0 AS disamenity, (p_partkey % 19) / 10e0 AS lna, (p_partkey % 40) / 1e0 AS inventory,
          1000e0 + (p_partkey % 23) * 50e0 AS absorbed, p_type AS land_type, p_brand AS brand, p_retailprice AS raw_price
        FROM part"""),
    "a_history": (("lineitem",), """
        SELECT l_partkey AS cell, CAST(year(l_shipdate) AS BIGINT) AS year, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS light, count(*) AS n
        FROM lineitem GROUP BY l_partkey, year(l_shipdate)"""),
    "a_announcers": (("customer",), """
        SELECT c_custkey AS announcer_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey % 101) / 100e0 END AS delivery_ratio,
          CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey % 73 AS DOUBLE) END AS median_slip_months, CASE WHEN c_custkey % 8 = 0 THEN 0e0 ELSE 1000e0 * (c_custkey % 90) END AS mean_capex
        FROM customer"""),
    "a_projects": (("orders",), """
        SELECT o_orderkey AS project_id, o_custkey AS announcer_id, o_orderkey % 300 AS cell, o_orderstatus = 'F' AS is_public, o_totalprice AS capex,
          CAST(year(o_orderdate) AS BIGINT) AS announced_year, CAST(year(o_orderdate) AS BIGINT) + 1 + o_orderkey % 3 AS construction_year,
          CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE year(o_orderdate) + 3e0 + (o_orderkey % 9) / 2e0 END AS open_year,
          CASE o_orderkey % 8 WHEN 0 THEN 'announced' WHEN 1 THEN 'feasibility' WHEN 2 THEN 'dpr_prepared' WHEN 3 THEN 'dpr_approved' WHEN 4 THEN 'funded' WHEN 5 THEN 'land_majority' WHEN 6 THEN 'construction' ELSE 'half_complete' END AS stage,
          CASE o_orderkey % 5 WHEN 0 THEN 'verbal' WHEN 1 THEN 'summit_mou' WHEN 2 THEN 'land_allotted' WHEN 3 THEN 'board_approved' ELSE 'epc_appointed' END AS commitment_form,
          o_orderkey % 8 >= 6 AS claims_construction, CASE WHEN o_orderkey % 3 = 0 THEN 'none' WHEN o_orderkey % 3 = 1 THEN 'cleared' ELSE 'structure' END AS physical_state,
          o_orderkey % 200 AS physical_age_days, o_orderkey % 41 = 0 AS abandoned, o_orderkey % 16 AS modifier_bits
        FROM orders"""),
    "a_events": (("events",), """
        SELECT event_id, user_id AS project, ts, value, event_type, event_id % 9 AS pixel, event_id % 7 <> 0 AS clear,
          CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE NULL END AS state_rank
        FROM events"""),
    "a_bands": (("a_cells",), """
        SELECT cell, zone, price, amenity, disamenity, households, jobs, households * 4 AS population, households * 0.4e0 AS hh_low, households * 0.3e0 AS hh_mid, households * 0.2e0 AS hh_upper_mid, households * 0.1e0 AS hh_high,
          lna AS lna_low, lna * 0.9e0 AS lna_mid, lna * 0.8e0 AS lna_upper_mid, CASE WHEN cell % 41 = 0 THEN NULL ELSE lna * 0.7e0 END AS lna_high, (amenity - 0.5e0) / 10 AS field, absorbed / 2 AS headroom, builtup_frac,
          absorbed * 50 AS capacity_sqm, x_m, y_m
        FROM a_cells"""),
    "a_jobs": (("orders",), """
        SELECT o_orderkey AS project_id, o_orderkey % 300 AS cell, CASE o_orderkey % 4 WHEN 0 THEN 'it_office' WHEN 1 THEN 'manuf_light' WHEN 2 THEN 'logistics' ELSE 'retail_svc' END AS sector, 10e0 + o_orderkey % 90 AS jobs,
          8000e0 + (o_orderkey % 40) * 4000e0 AS wage, CAST(year(o_orderdate) AS BIGINT) AS start_year, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1e0 + o_orderkey % 4 END AS ramp_years,
          CASE WHEN o_orderkey % 4 = 1 THEN 0.3e0 ELSE NULL END AS dormitory_share
        FROM orders"""),
    "a_sites": (("orders",), """
        SELECT o_orderkey AS project_id, CASE o_orderkey % 3 WHEN 0 THEN 'rail' WHEN 1 THEN 'data' ELSE 'plant' END AS archetype, CASE WHEN o_orderkey % 4 = 3 THEN -1 ELSE o_orderkey % 300 END AS cell, 300e0 + (o_orderkey % 97) * 200e0 AS x, (o_orderkey % 89) * 40e0 AS y,
          10e0 + o_orderkey % 50 AS scale, (o_orderkey % 10) / 10e0 AS weight, year(o_orderdate) + 2.5e0 AS open_year, year(o_orderdate) + 1e0 AS construction_start, year(o_orderdate) + 0e0 AS announced_year,
          o_orderkey % 2 = 0 AS elevated, o_orderkey % 5 = 0 AS interchange,
          300e0 + (o_orderkey % 97) * 200e0 + ((o_orderkey % 7) - 3) * 300e0 AS x2, (o_orderkey % 89) * 40e0 + ((o_orderkey % 11) - 5) * 260e0 AS y2,
          300e0 + (o_orderkey % 97) * 200e0 + ((o_orderkey % 7) - 3) * 300e0 + ((o_orderkey % 5) - 2) * 450e0 AS x3, (o_orderkey % 89) * 40e0 + ((o_orderkey % 11) - 5) * 260e0 + 500e0 AS y3,
          60e0 + (o_orderkey % 13) * 70e0 AS wide, 90e0 + (o_orderkey % 17) * 50e0 AS high
        FROM orders"""),
    "a_pixels": (("events",), """
        SELECT user_id AS project_id, ts AS time, event_id % 9 AS px, event_id % 12 AS scl, (event_id % 23) / 50e0 AS b02, (event_id % 19) / 40e0 AS b03, (event_id % 17) / 30e0 AS b04, 0.1e0 + (event_id % 29) / 40e0 AS b08, 0.1e0 + (event_id % 31) / 60e0 AS b11
        FROM events"""),
    "a_months": (("lineitem",), """
        SELECT l_suppkey AS project_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg((l_orderkey % 40) / 64e0) AS ndvi, avg((l_orderkey % 37) / 64e0) AS ndbi, avg((l_orderkey % 29) / 64e0) AS bsi, avg((l_orderkey % 11) / 16e0) AS brightness,
          avg((l_orderkey % 5) / 8e0) AS cloud_frac, avg((l_orderkey % 5) / 8e0) <= 0.4e0 AS valid, avg(1e0 + l_orderkey % 13) AS light
        FROM lineitem GROUP BY l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE)"""),
    "a_part_months": (("lineitem",), """
        SELECT l_partkey AS project_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg((l_orderkey % 40) / 64e0) AS ndvi, avg((l_orderkey % 37) / 64e0) AS ndbi, avg((l_orderkey % 29) / 64e0) AS bsi, avg((l_orderkey % 11) / 16e0) AS brightness,
          avg((l_orderkey % 5) / 8e0) AS cloud_frac, avg((l_orderkey % 5) / 8e0) <= 0.4e0 AS valid, avg(1e0 + l_orderkey % 13) AS light
        FROM lineitem GROUP BY l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE)"""),
    "a_cards": (("nation",), """
        SELECT n_name AS city, CAST(2010 AS BIGINT) AS t0, CAST(10 AS BIGINT) AS horizon, CAST(20 + n_nationkey AS BIGINT) AS n_zones, 0.5e0 + (n_nationkey % 7) / 20e0 AS spearman, (n_nationkey % 4) / 3e0 AS top_precision,
          (n_nationkey % 11) / 50e0 - 0.04e0 AS beat_b2, -0.1e0 AS beat_b2_low, 0.2e0 AS beat_b2_high, 0.7e0 + (n_nationkey % 5) / 20e0 AS coverage, 0.5e0 AS overheat_precision, 0.1e0 AS mape, 0.4e0 AS settlement_spearman,
          (n_nationkey % 9) / 30e0 - 0.1e0 AS beat_b4, n_nationkey % 6 <> 0 AS price_test, 0.5e0 + (n_nationkey % 7) / 20e0 > 0.8e0 AS alarm, FALSE AS underpowered
        FROM nation"""),
    "a_districts": (("supplier",), """
        SELECT zone_id, x0, y0, wide, high, people, zone, far, CASE WHEN form = 1 THEN x0 + wide / 4 WHEN form = 2 THEN x0 + wide / 2 ELSE x0 END AS rx0, CASE WHEN form = 1 THEN y0 + high / 4 WHEN form = 2 THEN y0 + high / 2 ELSE y0 END AS ry0,
          CASE WHEN form = 0 THEN x0 WHEN form = 1 THEN x0 + wide / 2 ELSE x0 + wide END AS rx1, CASE WHEN form = 0 THEN y0 WHEN form = 1 THEN y0 + high / 2 ELSE y0 + high END AS ry1, form
        FROM (SELECT s_suppkey AS zone_id, (s_suppkey % 37) * 480e0 - 140e0 AS x0, (s_suppkey % 41) * 420e0 - 60e0 AS y0, 400e0 + (s_suppkey % 7) * 320e0 AS wide, 400e0 + (s_suppkey % 5) * 280e0 AS high,
          1000e0 + (s_suppkey % 13) * 370e0 AS people, CASE s_suppkey % 4 WHEN 0 THEN 'res' WHEN 1 THEN 'com' WHEN 2 THEN 'mix' ELSE 'ind' END AS zone, 1e0 + s_suppkey % 3 AS far, s_suppkey % 3 AS form FROM supplier) s"""),
    "a_draws": (("part",), """
        SELECT d AS draw, p_partkey AS cell, ln(p_retailprice) + ((p_partkey * 7919 + d * 104729) % 1009) / 1009e0 - 0.5e0 AS value
        FROM part CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) s(d)"""),
}


def ctes(name: str, seen: list[str] | None = None) -> list[str]:
    """The views that a view needs, itself last."""
    seen = [] if seen is None else seen
    for source in VIEWS[name][0]:
        if source in VIEWS:
            ctes(source, seen)
    if name not in seen:
        seen.append(name)
    return seen


def with_views(*names: str) -> str:
    """WITH clause for DuckDB."""
    need: list[str] = []
    for n in names:
        ctes(n, need)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in need)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the star schema's tables are read for it alone."""
    sources, sql = VIEWS[name]
    frames = {s: view(spark, sf_dir, s) if s in VIEWS else table(spark, sf_dir, s) for s in sources}
    text = sql
    for s in frames:
        text = text.replace(f"FROM {s}", f"FROM {{{s}}}")
    return spark.sql(text, **frames)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
