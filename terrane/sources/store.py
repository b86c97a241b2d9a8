"""A Parquet store: validated writes, filtered reads, order-free content hashes, snapshots that cannot change unseen."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.measures import read_where, upsert
from terrane.schema import Table


class StoreError(ValueError):
    """A table, mode or snapshot is not as it should be."""


def content_hash(df: DataFrame) -> str:
    """SHA-256 over columns in name order and all rows, whatever their order and partitions.

    Doubles count to 12 significant digits and NaN as null. Row digests are summed limb by limb, which is one partial
    aggregate with no sort; equal rows count as often as they occur.
    """
    parts = []
    for name, kind in sorted(df.dtypes):
        value = F.col(name)
        if kind in ("double", "float"):
            value = F.when(F.col(name).isNotNull() & ~F.isnan(name), F.format_string("%.11e", F.col(name).cast("double")))
        elif kind == "binary":
            value = F.hex(name)
        elif kind.startswith(("array", "map", "struct")):
            value = F.to_json(F.struct(name))
        parts.append(F.coalesce(F.concat(F.lit(f"{name}:{kind}="), value.cast("string")), F.lit(f"{name}:{kind}?")))
    row = F.sha2(F.to_json(F.array(*parts)), 256)
    limbs = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(8)]
    got = df.agg(F.count(F.lit(1)).alias("n"), *limbs).first()
    said = json.dumps([sorted(df.dtypes), got["n"], [str(got[f"l{i}"] or 0) for i in range(8)]])
    return hashlib.sha256(said.encode()).hexdigest()


class Store:
    """Tables below a folder that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]) -> None:
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self.root}/{name}/_SUCCESS")
        return fs.exists(p)

    def read(self, name: str, **filters) -> DataFrame:
        """Rows that meet the filters; Spark pushes them to the scan."""
        if name not in self.tables:
            raise StoreError(f"no table {name}")
        return read_where(self.spark.read.parquet(f"{self.root}/{name}"), **filters)

    def write(self, name: str, df: DataFrame, mode: str = "append") -> None:
        """append, replace or upsert by key. Validation comes first; a new version is staged, then renamed."""
        if name not in self.tables:
            raise StoreError(f"no table {name}")
        table = self.tables[name]
        if mode not in ("append", "replace", "upsert"):
            raise StoreError(f"no mode {mode}")
        if mode == "upsert" and not table.key:
            raise StoreError(f"{name} has no key")
        table.validate(df)
        old = self.spark.read.parquet(f"{self.root}/{name}") if self.exists(name) and mode != "replace" else None
        if old is not None:
            df = upsert(old, df.select(*old.columns), list(table.key)) if mode == "upsert" else old.unionByName(df)
            if mode == "append" and table.key:
                table.validate(df)
        stage = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        df.write.parquet(stage)
        fs, target = self._fs(f"{self.root}/{name}")
        _, staged = self._fs(stage)
        fs.delete(target, True)
        if not fs.rename(staged, target):
            raise StoreError(f"{name}: rename failed")

    def snapshot(self, out: str, names: tuple[str, ...], params_hash: str, note: dict | None = None) -> str:
        """Copies of tables with a manifest of their content hashes; the snapshot's hash is that of the manifest."""
        manifest = {"params": params_hash, "tables": {}, "note": note or {}}
        for name in names:
            df = self.read(name)
            df.write.parquet(f"{out}/{name}")
            manifest["tables"][name] = {"hash": content_hash(self.spark.read.parquet(f"{out}/{name}")), "rows": self.spark.read.parquet(f"{out}/{name}").count()}
        text = json.dumps(manifest, sort_keys=True)
        self.spark.createDataFrame([(text,)], "manifest string").coalesce(1).write.parquet(f"{out}/_manifest")
        return hashlib.sha256(text.encode()).hexdigest()


def open_snapshot(spark: SparkSession, path: str, verify: str | None = None) -> dict[str, DataFrame]:
    """Tables of a snapshot; with a hash to verify, every row is read again and compared first."""
    text = spark.read.parquet(f"{path}/_manifest").first()[0]
    manifest = json.loads(text)
    if verify is not None:
        if hashlib.sha256(text.encode()).hexdigest() != verify:
            raise StoreError("the manifest was changed")
        for name, said in manifest["tables"].items():
            if content_hash(spark.read.parquet(f"{path}/{name}")) != said["hash"]:
                raise StoreError(f"{name} was changed")
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
