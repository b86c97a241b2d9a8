"""Running sums and exclusive-ors along an order, over groups of any size, without a group in one task.

Rows are cut into ranges by group and order, so a large group runs over several tasks. Each task scans its own rows;
of each range, its last row says what the next one starts with. Those last rows are as many as the ranges at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from terrane.llm.common import written
from terrane.sources.ship import ship_package


def _scan(batches: Iterator[pa.RecordBatch], group: str | None, sums: tuple[str, ...], xors: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Adds the running values within the rows of this task, its number, and whether a row is the task's last."""
    part = TaskContext.get().partitionId()
    carry, last_key, held = dict.fromkeys((*sums, *xors), 0), None, None

    def made(batch: pa.RecordBatch, columns: dict[str, np.ndarray], last: bool) -> pa.RecordBatch:
        ends = np.zeros(batch.num_rows, bool)
        ends[-1] = last
        extra = [pa.array(v) for v in columns.values()] + [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(ends)]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *(f"run_{c}" for c in columns), "_part", "_last"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.zeros(n, np.int64) if group is None else batch.column(group).to_numpy(zero_copy_only=False)
        new = np.r_[last_key is None or keys[0] != last_key, keys[1:] != keys[:-1]]
        starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: goes on from the batch before
        columns = {}
        for c in (*sums, *xors):
            x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(x) if c in sums else np.bitwise_xor.accumulate(x)
            base = np.where(starts > 0, np.r_[0, run[:-1]][np.maximum(starts, 0)], 0)
            run = run - base if c in sums else run ^ base
            goes_on = starts < 0
            run = np.where(goes_on, run + carry[c] if c in sums else run ^ carry[c], run)
            carry[c] = int(run[-1])
            columns[c] = run
        last_key = keys[-1]
        if held is not None:
            yield made(*held, last=False)
        held = (batch, columns)
    if held is not None:
        yield made(*held, last=True)


def running(df: DataFrame, order: list[Column], group: str | None = None, sums: tuple[str, ...] = (), xors: tuple[str, ...] = (), name: str = "scan") -> DataFrame:
    """df, written, with run_<c> for each of the long columns c: the sum (or exclusive-or) of c over the rows of the
    group (a long column without nulls; None: the whole table) up to and with this one, in the order given.

    Rows equal in group and order follow each other in any order. Sums wrap around at 64 bits. An empty table gives an
    empty table.
    """
    keys = ([F.col(group)] if group else []) + order
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    fields = [StructField(f"run_{c}", LongType()) for c in (*sums, *xors)] + [StructField("_part", IntegerType()), StructField("_last", BooleanType())]
    ship_package(df.sparkSession)
    local = written(ranged.mapInArrow(partial(_scan, group=group, sums=sums, xors=xors), StructType([*df.schema.fields, *fields])), name)

    # one row for each range: what has been summed of its last group, and where that group may go on
    key = group or "_all"
    lasts = local.filter("_last").select("_part", (F.col(group) if group else F.lit(0).cast("long")).alias(key), *[f"run_{c}" for c in (*sums, *xors)])
    so_far = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    before = lasts.select(
        F.lead("_part").over(Window.orderBy("_part")).alias("_part"), key,
        *[F.sum(f"run_{c}").over(so_far).alias(f"add_{c}") for c in sums],
        *[F.bit_xor(f"run_{c}").over(so_far).alias(f"add_{c}") for c in xors],
    ).filter("_part IS NOT NULL")
    joined = local if group else local.withColumn(key, F.lit(0).cast("long"))
    joined = joined.join(F.broadcast(before), ["_part", key], "left")
    nil = F.lit(0).cast("long")
    runs = [(F.col(f"run_{c}") + F.coalesce(f"add_{c}", nil)).alias(f"run_{c}") for c in sums]
    runs += [F.col(f"run_{c}").bitwiseXOR(F.coalesce(f"add_{c}", nil)).alias(f"run_{c}") for c in xors]
    out = joined.select(*df.columns, *runs)
    out._written_path = local._written_path
    return out
