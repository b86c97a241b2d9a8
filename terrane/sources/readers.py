"""Source readers: files by Spark, tables in memory for tests, and state adapters by code."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.params import ParamError


class Reader(Protocol):
    def exists(self, name: str) -> bool: ...

    def table(self, name: str) -> DataFrame: ...


class FileReader:
    """CSV, JSON lines and Parquet below a folder; CSV needs a schema, so no pass over the data infers one."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None) -> None:
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas or {}

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        path, kind = f"{self.root}/{name}", name.rpartition(".")[2]
        if kind == "csv":
            return self.spark.read.schema(self.schemas[name]).option("header", True).option("mode", "FAILFAST").csv(path)
        if kind in ("json", "geojson"):
            reader = self.spark.read.schema(self.schemas[name]) if name in self.schemas else self.spark.read
            return reader.option("multiLine", kind == "geojson").json(path)
        if kind == "orc":
            return self.spark.read.orc(path)
        return self.spark.read.parquet(path)


class MemoryReader:
    """Frames by name."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables = tables

    def exists(self, name: str) -> bool:
        return name in self.tables

    def table(self, name: str) -> DataFrame:
        return self.tables[name]


class MissingCapability(LookupError):
    """A state has no such register."""


def _typed(raw: DataFrame, wanted: dict[str, str]) -> list:
    """Columns by name and type; absent ones are typed nulls."""
    return [F.col(c).cast(t).alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()]


class StateAdapter:
    """Normalises one state's registers. What a state does not have raises for guidance and projects, which every city
    needs, and is None for the rest."""

    code = ""
    #: How the registers may be read: seconds between requests, and whether in bulk.
    terms: dict = {"seconds_between": 1.0, "bulk": False}

    def guidance(self, raw: DataFrame) -> DataFrame:
        raise MissingCapability(f"{self.code}: guidance")

    def projects(self, raw: DataFrame) -> DataFrame:
        raise MissingCapability(f"{self.code}: projects")

    def registrations(self, raw: DataFrame) -> DataFrame | None:
        return None

    def parcels(self, raw: DataFrame) -> DataFrame | None:
        return None

    def allotments(self, raw: DataFrame) -> DataFrame | None:
        return None

    def capabilities(self) -> set[str]:
        """What this state has."""
        return {n for n in ("guidance", "projects", "registrations", "parcels", "allotments") if getattr(type(self), n) is not getattr(StateAdapter, n)}

    def access_terms(self) -> dict:
        return dict(self.terms)

    def check_bulk(self, what: str) -> None:
        if not self.terms["bulk"]:
            raise PermissionError(f"{self.code}: {what} may not be read in bulk")


class SquareYardAdapter(StateAdapter):
    """A state whose guidance values are by the square yard; absent columns become typed nulls."""

    code = "AP"

    def guidance(self, raw: DataFrame) -> DataFrame:
        return raw.select(*_typed(raw, {"locality_id": "string", "sro_code": "string", "effective_year": "long"}), (F.col("guidance_inr_sqyd") / 9).alias("guidance_inr_sqft"))

    def projects(self, raw: DataFrame) -> DataFrame:
        return raw.select(*_typed(raw, {"rera_id": "string", "project_name": "string", "promoter": "string", "lat": "double", "lon": "double", "total_units": "long", "declared_completion": "date"}))

    def registrations(self, raw: DataFrame) -> DataFrame:
        """Transactions by the square foot; rows without a price or an area go."""
        price = F.col("consideration_inr") / F.when(F.col("area_sqyd") > 0, F.col("area_sqyd") * 9)
        rows = raw.select(*_typed(raw, {"document_id": "string", "locality_id": "string", "registered_on": "date"}), price.alias("price_inr_sqft"))
        return rows.filter("price_inr_sqft IS NOT NULL")

    def parcels(self, raw: DataFrame) -> DataFrame:
        return raw.select(*_typed(raw, {"parcel_id": "string", "survey_no": "string", "lat": "double", "lon": "double"}), (F.col("extent_acres") * 4046.8564224).alias("area_sqm"))

    def allotments(self, raw: DataFrame) -> DataFrame:
        return raw.select(*_typed(raw, {"allotment_id": "string", "allottee": "string", "sector": "string", "allotted_on": "date", "lat": "double", "lon": "double"}), (F.col("extent_acres") * 4046.8564224).alias("area_sqm"))


ADAPTERS = {a.code: a for a in (SquareYardAdapter,)}


def adapter_for(code: str) -> StateAdapter:
    if code not in ADAPTERS:
        raise ParamError(f"no adapter for {code}")
    return ADAPTERS[code]()
