"""Ledgers: ingest runs named by their content, imputations, and a review queue of append-only decisions."""

from __future__ import annotations

import hashlib
import json

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.ingest import merge
from terrane.operators.measures import upsert

RUNS = "run_id string, source string, city string, columns array<string>, rows long, params_hash string, content_hash string, parents array<string>"
CANDIDATE = "record_type string, project_id string, field string, value string, confidence double, is_new boolean, is_stage_change boolean"


def ingest_run(spark: SparkSession, source: str, city: str, columns: list[str], rows: int, params_hash: str, content_hash: str, parents: tuple[str, ...] = ()) -> DataFrame:
    """One ledger row; the same content under the same parameters has the same id."""
    said = [source, city, sorted(columns), params_hash, content_hash, sorted(parents)]
    run_id = hashlib.sha256(json.dumps(said).encode()).hexdigest()[:32]
    return spark.createDataFrame([(run_id, source, city, sorted(columns), rows, params_hash, content_hash, sorted(parents))], RUNS)


def unaccounted(cells: DataFrame, runs: DataFrame, exempt: tuple[str, ...] = ()) -> list[str]:
    """Columns that hold a value and that no run filled: one aggregate over cells, an anti join to the ledger."""
    names = [c for c in cells.columns if c not in exempt]
    held = cells.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in names])
    long = held.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("held")) for c in names])).alias("c")).select("c.column", "c.held").filter("held")
    return sorted(r[0] for r in long.join(runs.select(F.explode("columns").alias("column")), "column", "left_anti").collect())


def parse_candidates(answers: DataFrame, text: str) -> DataFrame:
    """Extraction answers to typed candidates; code fences go first, and what is no such JSON gets status parse_failed."""
    bare = F.regexp_replace(F.col(text), r"^\s*```[a-z]*\s*|\s*```\s*$", "")
    out = answers.withColumn("_c", F.from_json(bare, CANDIDATE))
    good = F.col("_c").isNotNull() & F.col("_c.record_type").isNotNull() & F.col("_c.confidence").between(0, 1)
    return out.select(*answers.columns, "_c.*", F.when(good, "parsed").otherwise("parse_failed").alias("status"))


def queue_state(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each candidate with its last decision (candidate_id, at, decision, value, reviewer), or pending."""
    best = decisions.groupBy("candidate_id").agg(F.max(F.struct("at", "decision", F.col("value").alias("decided"), "reviewer")).alias("d"))
    return candidates.join(best, "candidate_id", "left").select(
        *[F.col(c) for c in candidates.columns if c != "value"], F.coalesce("d.decided", "value").alias("value"), F.coalesce("d.decision", F.lit("pending")).alias("decision"), "d.reviewer"
    )


def history_rows(state: DataFrame) -> DataFrame:
    """Applied decisions as project_history rows."""
    done = state.filter(F.col("decision").isin("approved", "edited", "auto_applied"))
    return done.select("project_id", "field", F.lit(None).cast("string").alias("old_value"), F.col("value").alias("new_value"), F.coalesce("reviewer", F.lit("auto")).alias("changed_by"))


def upsert_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger after a run: rows of the same id are replaced."""
    return upsert(old, new.select(*old.columns), ["run_id"])


def append_imputation(old: DataFrame, new: DataFrame) -> DataFrame:
    """The imputation ledger with more rows; nothing in it is ever changed."""
    return old.unionByName(new.select(*old.columns))


def imputation_rows(cells: DataFrame, key: str, run_id: str) -> DataFrame:
    """(key, column, method, run_id) of every value that mark_imputed flagged; the columns are melted in one pass."""
    names = [x[: -len("__imputed")] for x in cells.columns if x.endswith("__imputed")]
    if not names:
        return cells.select(key, F.lit("").alias("column"), F.lit("").alias("method"), F.lit(run_id).alias("run_id")).filter("false")
    flags = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"{n}__method").alias("method"), F.coalesce(F.col(f"{n}__imputed"), F.lit(False)).alias("on")) for n in names]))
    return cells.select(key, flags.alias("f")).filter("f.on").select(key, "f.column", "f.method", F.lit(run_id).alias("run_id"))


def derived_run(spark: SparkSession, step: str, city: str, columns: list[str], rows: int, params_hash: str, content_hash: str, parents: list[str]) -> DataFrame:
    """The ledger row of columns that were computed from others; it names the runs it rests on, at least one."""
    if not parents:
        raise ValueError("derived columns rest on other runs")
    return ingest_run(spark, f"derived:{step}", city, columns, rows, params_hash, content_hash, tuple(parents))


def run_steps(cells: DataFrame, steps: list[tuple[str, list[str], Callable[[DataFrame], DataFrame]]], key: str, city: str, params_hash: str, cut: Callable[[DataFrame], DataFrame], hash_of: Callable[[DataFrame], str]) -> tuple[DataFrame, DataFrame]:
    """Cells after all ingest steps, and their ledger.

    A step (source, columns, make) gives a frame by key whose columns replace those of cells; a key it repeats, or a
    column it promised and did not give, raises. Each step is written by cut before the next; the ledger is one union.
    """
    spark, rows = cells.sparkSession, []
    for source, columns, make in steps:
        got = make(cells)
        lost = [x for x in columns if x not in got.columns]
        if lost:
            raise ValueError(f"{source} did not give {lost}")
        part = cut(got.select(key, *columns))
        cells = cut(merge(cells, part, key))
        rows.append(ingest_run(spark, source, city, columns, part.count(), params_hash, hash_of(part)))
    ledger = spark.createDataFrame([], RUNS)
    for r in rows:
        ledger = ledger.unionByName(r)
    return cells, ledger
