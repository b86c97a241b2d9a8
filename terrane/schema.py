"""Declared tables: columns, checks and keys; DDL and one-pass validation from the same declaration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed vocabularies, in order where order has meaning.
SECTORS = ("agri", "manuf_heavy", "manuf_light", "logistics", "it_office", "retail_svc", "public_edu", "construction")
BANDS = ("low", "mid", "upper_mid", "high")
STAGES = ("announced", "feasibility", "dpr_prepared", "dpr_approved", "funded", "land_majority", "construction", "half_complete")
UTILITIES = ("none", "water", "water_sewer", "water_sewer_power")
ELASTICITY = ("dense_core", "constrained_periph", "typical_periph", "open_fringe")


class SchemaError(ValueError):
    """All violations of a table, reported together."""


@dataclass(frozen=True)
class Col:
    name: str
    type: str
    nullable: bool = False
    optional: bool = False
    low: float | None = None
    high: float | None = None
    among: tuple[str, ...] = ()
    length: int | None = None

    def check(self) -> Column:
        """True where the value is allowed."""
        v = F.col(self.name)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (v >= self.low)
        if self.high is not None:
            ok = ok & (v <= self.high)
        if self.among:
            ok = ok & v.isin(*self.among)
        if self.length is not None:
            ok = ok & (F.size(v) == self.length)
        return F.when(v.isNull(), F.lit(self.nullable)).otherwise(ok)


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...]
    columns: tuple[Col, ...] = field(default=())

    def ddl(self) -> str:
        """Column DDL, key first as declared."""
        return ", ".join(f"{c.name} {c.type.upper()}{'' if c.nullable or c.optional else ' NOT NULL'}" for c in self.columns)

    def struct(self) -> StructType:
        return StructType.fromDDL(", ".join(f"{c.name} {c.type}" for c in self.columns))

    def violations(self, df: DataFrame) -> list[str]:
        """Names and types first; then one aggregate for all checks and one for the key."""
        known = {c.name: c for c in self.columns}
        types = dict(df.dtypes)
        out = [f"unknown column {c}" for c in types if c not in known]
        out += [f"missing column {c.name}" for c in self.columns if c.name not in types and not c.optional]
        out += [f"{n}: {types[n]} is not {c.type}" for n, c in known.items() if n in types and types[n] != c.type]
        if out:
            return out
        found = {r["check"]: r["n"] for r in self.counts(df).collect()}  # a row a column
        return [f"key {self.key}: {n} repeated" if name == "key" else f"{name}: {n} rows out of bounds" for name, n in sorted(found.items())]

    def counts(self, df: DataFrame) -> DataFrame:
        """(check, n) of every column with rows out of bounds, and of repeated keys as 'key': two aggregates."""
        there = [c for c in self.columns if c.name in df.columns]
        row = df.agg(*[F.count_if(~c.check()).alias(c.name) for c in there])
        out = row.select(F.explode(F.array(*[F.struct(F.lit(c.name).alias("check"), F.col(c.name).alias("n")) for c in there])).alias("c")).select("c.check", "c.n")
        if self.key:
            again = df.groupBy(*self.key).count().filter("count > 1").agg(F.lit("key").alias("check"), F.count(F.lit(1)).alias("n"))
            out = out.unionByName(again)
        return out.filter("n > 0")

    def validate(self, df: DataFrame) -> DataFrame:
        found = self.violations(df)
        if found:
            raise SchemaError(f"{self.name}: " + "; ".join(found))
        return df


def _numbers(names: str, **how) -> tuple[Col, ...]:
    return tuple(Col(n, "double", **how) for n in names.split())


CELLS = Table("cells", ("h3",), (
    Col("h3", "string"), Col("h3_res8", "string"), Col("in_city", "boolean"), Col("geometry", "binary", nullable=True),
    *_numbers("lat", low=-90, high=90), *_numbers("lon", low=-180, high=180), *_numbers("area_sqm", low=0), *_numbers("elev_m slope_pct"),
    Col("landcover", "string"), *_numbers("builtup_frac undevelopable_frac", low=0, high=1), Col("zone_class", "string"), *_numbers("permitted_far", low=0), Col("crz_class", "string"),
    *_numbers("population households", low=0), Col("hh_by_band", "array<double>", length=4), Col("jobs_by_sector", "array<double>", length=8),
    *_numbers("floorspace_res_sqm floorspace_com_sqm", low=0), *_numbers("price_res_inr_sqft price_land_inr_sqft rent_res_inr_sqft_mo mean_parcel_sqm", nullable=True, low=0),
    Col("parcel_count", "bigint", low=0), *(Col(n, "bigint", low=0, high=1) for n in ("util_water", "util_sewer", "util_power")),
    *_numbers("dist_cbd_m dist_arterial_m", low=0), *_numbers("dist_coast_m", nullable=True, low=0), *_numbers("nightlight"), *_numbers("data_conf", low=0, high=1),
    Col("utility_state", "string", nullable=True, optional=True, among=UTILITIES), Col("elasticity_class", "string", nullable=True, optional=True, among=ELASTICITY),
    *_numbers("capacity_sqm headroom_sqm eps_supply lnA jobs_30min jobs_45min jobs_60min station_weight alpha_res inventory_months hist_absorption_sqm", nullable=True, optional=True),
))
CELLS_HISTORY = Table("cells_history", ("h3", "year"), (Col("h3", "string"), Col("year", "bigint"), *_numbers("builtup_frac nightlight population price_res_inr_sqft", nullable=True)))
PROJECTS = Table("projects", ("project_id",), (
    Col("project_id", "string"), Col("archetype", "string"), Col("geom", "string"), Col("announcer_id", "string", nullable=True), Col("is_public", "boolean"),
    *_numbers("scale_value", low=0), *_numbers("capex_inr_cr", nullable=True, low=0), Col("announced_date", "date"), Col("stated_completion", "date"),
    Col("stage", "string", among=STAGES), Col("stage_asof", "date"), Col("commitment_form", "string", nullable=True), Col("modifiers", "array<string>"), Col("verified_by", "string", nullable=True),
))
PROJECT_HISTORY = Table("project_history", (), (*(Col(n, "string") for n in ("project_id", "field")), *(Col(n, "string", nullable=True) for n in ("old_value", "new_value")), Col("changed_at", "timestamp_ntz"), Col("source_url", "string"), Col("changed_by", "string")))
ANNOUNCERS = Table("announcers", ("announcer_id",), (Col("announcer_id", "string"), Col("name", "string"), *_numbers("delivery_ratio median_slip_months mean_annual_capex_3y_inr_cr", nullable=True)))
PHYSICAL_HISTORY = Table("project_physical_history", ("project_id", "month"), (
    Col("project_id", "string"), Col("month", "date"), *_numbers("ndvi ndbi bsi brightness cloud_frac", nullable=True), Col("valid", "boolean"), *_numbers("dndvi dndbi dbsi", nullable=True),
    Col("light_rose", "boolean"), Col("state", "string", nullable=True, among=("none", "cleared", "earthworks", "structure", "operational")), Col("state_cum", "string", nullable=True),
))
INGEST_RUNS = Table("ingest_runs", ("run_id",), (Col("run_id", "string"), Col("source", "string"), Col("city", "string"), Col("columns", "array<string>"), Col("rows", "bigint", low=0), Col("params_hash", "string"), Col("content_hash", "string"), Col("parents", "array<string>")))
CELL_IMPUTATION = Table("cell_imputation", (), (Col("h3", "string"), Col("column", "string"), Col("method", "string"), Col("run_id", "string")))
TABLES = {t.name: t for t in (CELLS, CELLS_HISTORY, PROJECTS, PROJECT_HISTORY, ANNOUNCERS, PHYSICAL_HISTORY, INGEST_RUNS, CELL_IMPUTATION)}
