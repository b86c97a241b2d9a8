"""What the operators of this subpackage share: shared-folder tables, text helpers, Arrow passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrane.sources.ship import ship_package, shared_dir

#: The six ASCII blanks, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Fixed patterns of the contracts: words between blanks, and what separates alphanumeric words.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables; Spark's reader alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors.

    The table goes when the application ends, or before that by forget() or forget_since().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, target = _target(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    _WRITTEN.append(path)
    return out


#: Paths of the tables that written() made and nothing deleted, in order.
_WRITTEN: list[str] = []


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def written_so_far() -> int:
    """A mark for forget_since()."""
    return len(_WRITTEN)


def forget_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Deletes the tables made since the mark, but for keep, which no longer reads them."""
    kept = getattr(keep, "_written_path", None)
    for path in _WRITTEN[mark:]:
        if path != kept:
            fs, target = _target(spark, path)
            fs.delete(target, True)
    _WRITTEN[mark:] = [kept] if kept else []


def forget(df: DataFrame) -> None:
    """Deletes a table made by written() that no later result reads."""
    path = getattr(df, "_written_path", None)
    if path:
        fs, target = _target(df.sparkSession, path)
        fs.delete(target, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does just that where all bytes are ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_blanks(text: Column) -> Column:
    """Strips the six ASCII blanks at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a lambda's variable, which the optimizer cannot write out at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df does not have (Spark ignores case)."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, max_rows: int = 512) -> DataFrame:
    """mapInArrow over batches of at most max_rows rows, so that a batch of very long texts stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max_rows):
                out = fn(batch.slice(at, max_rows))
                if out is not None:
                    yield out

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()
