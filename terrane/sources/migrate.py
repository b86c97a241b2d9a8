"""What surrounds a store: a ledger of migrations, metadata of geometry columns, provenance of runs and a cache of them."""

from __future__ import annotations

import hashlib
import json
import logging
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from terrane.params import Params
from terrane.schema import TABLES, Table

LOG = logging.getLogger(__name__)
LEDGER = "_migrations"
#: Geometry columns, their encoding and reference system.
GEOMETRY = (("cells", "geometry", "wkb", "EPSG:4326"), ("projects", "geom", "wkt", "EPSG:4326"))


class ProvenanceError(RuntimeError):
    """A run's numbers could not be traced."""


@dataclass(frozen=True)
class Migration:
    """A numbered step. apply makes or changes tables below the store's folder, and must bear being run again."""

    version: int
    name: str
    apply: Callable[[SparkSession, str], None]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create_table(table: Table) -> Callable[[SparkSession, str], None]:
    """A step that makes an empty table of the declared columns, unless it is there."""

    def apply(spark: SparkSession, root: str) -> None:
        fs, p = _fs(spark, f"{root}/{table.name}/_SUCCESS")
        if not fs.exists(p):
            spark.createDataFrame([], table.struct()).write.mode("overwrite").parquet(f"{root}/{table.name}")

    return apply


MIGRATIONS = tuple(Migration(i + 1, f"create {name}", create_table(t)) for i, (name, t) in enumerate(sorted(TABLES.items())))


def applied(spark: SparkSession, root: str) -> dict[int, str]:
    """Versions that the ledger has, and their names: one small file each."""
    fs, p = _fs(spark, f"{root}/{LEDGER}")
    if not fs.exists(p):
        return {}
    return {int(v): name for f in fs.listStatus(p) for v, _, name in [f.getPath().getName().partition("-")] if v.isdigit()}


def migrate(spark: SparkSession, root: str, migrations: tuple[Migration, ...] = MIGRATIONS) -> list[int]:
    """Applies the steps that the ledger lacks, in order, and enters each after it; the versions applied.

    A step that fails is not entered and stops the rest; running again goes on from there. Repeated versions, and a
    name that differs from the ledger's, raise.
    """
    if len({m.version for m in migrations}) != len(migrations):
        raise ValueError("a version is repeated")
    have, done = applied(spark, root), []
    for m in sorted(migrations, key=lambda m: m.version):
        said = m.name.replace(" ", "_")
        if m.version in have:
            if have[m.version] != said:
                raise ValueError(f"migration {m.version} is {have[m.version]} in the ledger, not {said}")
            continue
        m.apply(spark, root)
        fs, p = _fs(spark, f"{root}/{LEDGER}/{m.version}-{said}")
        fs.create(p, False).close()
        done.append(m.version)
    return done


def connect(spark: SparkSession, root: str, read_only: bool = False):
    """The store below a folder, which is made and migrated unless it is only read."""
    from terrane.sources.store import Store, StoreError

    fs, p = _fs(spark, root)
    if read_only:
        if not fs.exists(p):
            raise StoreError(f"no store at {root}")
    else:
        fs.mkdirs(p)
        migrate(spark, root)
    return Store(spark, root, TABLES)


def geometry_metadata(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, encoding, crs) of every geometry column."""
    return spark.createDataFrame(sorted(GEOMETRY), "table_name string, column_name string, encoding string, crs string")


def git_state(root: str | Path) -> tuple[str, bool]:
    """(commit, dirty) of a working tree; an unknown commit counts as dirty."""

    def git(*words: str) -> str | None:
        try:
            got = subprocess.run(["git", "-C", str(root), *words], capture_output=True, text=True, timeout=30, check=False)
        except (OSError, subprocess.SubprocessError):
            return None
        return got.stdout.strip() if got.returncode == 0 else None

    commit, status = git("rev-parse", "HEAD"), git("status", "--porcelain")
    return commit or "unknown", commit is None or status is None or bool(status)


def run_provenance(snapshot_hash: str, p: Params, root: str | Path = ".", allow_dirty: bool = False, code: tuple[str, bool] | None = None) -> dict:
    """Snapshot, parameters and code of a run. An unknown or changed working tree is refused unless that is allowed,
    which the result then says; code is for workers that were told the answer."""
    commit, dirty = git_state(root) if code is None else code
    problems = [said for said, bad in (("the commit is unknown", commit == "unknown"), ("the working tree has changes", dirty), ("the snapshot's hash is empty", not snapshot_hash), ("the parameters' hash is empty", not p.hash())) if bad]
    if problems and not allow_dirty:
        raise ProvenanceError("; ".join(problems))
    if problems:
        LOG.warning("provenance is incomplete: %s", "; ".join(problems))
    return {"snapshot": snapshot_hash, "params": p.hash(), "code": commit, "dirty": dirty, "dirty_override": allow_dirty}


class RunCache:
    """Results of runs by what they were made from, as tables below a folder; a run is never computed twice."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def key(self, params_hash: str, scenario: str, snapshot: str, seed: int) -> str:
        return hashlib.sha256(json.dumps([params_hash, scenario, snapshot, seed]).encode()).hexdigest()[:32]

    def get(self, key: str) -> DataFrame | None:
        fs, p = _fs(self.spark, f"{self.root}/{key}/_SUCCESS")
        return self.spark.read.parquet(f"{self.root}/{key}") if fs.exists(p) else None

    def run(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The cached result, or that of make, which is written first."""
        there = self.get(key)
        if there is not None:
            return there
        make().write.mode("overwrite").parquet(f"{self.root}/{key}")
        return self.spark.read.parquet(f"{self.root}/{key}")
