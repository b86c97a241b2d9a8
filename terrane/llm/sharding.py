"""Reproducible sharding: a Feistel permutation over global row numbers, with cycle walking.

Rows get gapless numbers 0..n-1 without a global sort: a hash bucket for each row, one count for each of the
(fixed number of) buckets, a running sum over those counts, and row_number() inside each bucket. A Feistel network
over an a-by-b grid (a*b >= n, less than n + a) permutes the numbers; a number outside 0..n-1 is sent round again
(cycle walking). From the permuted position p, shard = p mod shards and slot = p div shards, so shard sizes differ by
at most one, slots have no gaps, and both can be computed from the row number alone, in either direction.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import free_name

#: Buckets for numbering rows: a fixed number, so the table of their counts is of bounded size.
BUCKETS = 4096
SHARDS = 24
SEED = 20240607
ROUNDS = 6
PRIME = 2147483647
#: Points outside 0..n-1 number less than sqrt(n) + 1; beyond this many in a row the query fails rather than be wrong.
WALK = 64


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """(factor, offset) of each round, from the seed by a linear congruence."""
    out, x = [], seed % PRIME
    for _ in range(rounds):
        x = (x * 48271 + 11) % PRIME
        factor = x | 1
        x = (x * 48271 + 11) % PRIME
        out.append((factor, x))
    return out


def permute(x: int, n: int, seed: int = SEED) -> int:
    """Position of row number x among n rows: the same arithmetic on the driver."""
    a, b = grid(n)
    while True:
        left, right = divmod(x, b)
        for i, (factor, offset) in enumerate(round_keys(seed)):
            if i % 2 == 0:
                left = (left + _mix(right, factor, offset)) % a
            else:
                right = (right + _mix(left, factor, offset)) % b
        x = left * b + right
        if x < n:
            return x


def unpermute(p: int, n: int, seed: int = SEED) -> int:
    """Row number at position p: shard s and slot k hold the row unpermute(k * shards + s, n)."""
    a, b = grid(n)
    while True:
        left, right = divmod(p, b)
        for i, (factor, offset) in reversed(list(enumerate(round_keys(seed)))):
            if i % 2 == 0:
                left = (left - _mix(right, factor, offset)) % a
            else:
                right = (right - _mix(left, factor, offset)) % b
        p = left * b + right
        if p < n:
            return p


def grid(n: int) -> tuple[int, int]:
    """Sides of the grid: a = ceil(sqrt(n)), b = ceil(n / a)."""
    a = math.isqrt(max(n, 1) - 1) + 1 if n > 1 else 1
    return a, -(-max(n, 1) // a)


def _mix(x: int, factor: int, offset: int) -> int:
    y = (x % PRIME * factor + offset) % PRIME
    return y * y % PRIME


def _mix_col(x: Column, factor: int, offset: int) -> Column:
    y = (x % F.lit(PRIME) * F.lit(factor) + F.lit(offset)) % F.lit(PRIME)
    return y * y % F.lit(PRIME)


def text_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned; 0 (that of no bytes) for a null text."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def numbered(df: DataFrame, id_col: str, crc_col: str, out: str, total: str, tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """Adds out, the gapless row number from 0, and total, the number of rows.

    Rows are numbered by bucket, then id, then CRC, then tie_cols. Rows equal in all of these may swap numbers; rows
    without an id come first in their bucket. An empty table gives an empty table.
    """
    bucket, start, rank = (free_name(df, x) for x in ("_bucket", "_start", "_rank"))
    p = F.lit(PRIME)
    hashed = ((F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), p) * F.lit(48271) + F.col(crc_col)) % p * F.lit(69621) + F.lit(7)) % p
    rows = df.withColumn(bucket, (hashed % F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias(rank))
    # one row for each bucket: at most BUCKETS rows, whatever the table's size
    starts = counts.select(
        bucket,
        (F.sum(rank).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col(rank)).alias(start),
        F.sum(rank).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total),
    )
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(bucket).orderBy(F.col(id_col).asc_nulls_first(), crc_col, *tie_cols)))
    return ranked.join(F.broadcast(starts), bucket).withColumn(out, F.col(start) + F.col(rank) - F.lit(1)).drop(bucket, start, rank)


def permuted(df: DataFrame, number: str, total: str, out: str, seed: int = SEED) -> DataFrame:
    """Adds out, the permuted position of the row number; a Project for each round keeps the rounds in generated code."""
    a, b, left, right, pos = (free_name(df, x) for x in ("_a", "_b", "_l", "_r", "_p"))
    keys = round_keys(seed)
    root = F.ceil(F.sqrt(F.col(total).cast("double"))).cast("long")
    # the square root of a double may be off by one near squares of large numbers
    root = F.when(root * root < F.col(total), root + 1).when((root - 1) * (root - 1) >= F.col(total), root - 1).otherwise(root)
    df = df.withColumn(a, root)
    df = df.withColumn(b, F.expr(f"(`{total}` + `{a}` - 1) div `{a}`"))
    df = df.withColumn(left, F.expr(f"`{number}` div `{b}`")).withColumn(right, F.col(number) % F.col(b))
    for i, (factor, offset) in enumerate(keys):
        if i % 2 == 0:
            df = df.withColumn(left, (F.col(left) + _mix_col(F.col(right), factor, offset)) % F.col(a))
        else:
            df = df.withColumn(right, (F.col(right) + _mix_col(F.col(left), factor, offset)) % F.col(b))
    df = df.withColumn(pos, F.col(left) * F.col(b) + F.col(right))

    factors, offsets = (F.array(*[F.lit(k[j]).cast("long") for k in keys]) for j in (0, 1))

    def once(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            factor, offset = F.element_at(factors, i), F.element_at(offsets, i)
            low = acc % F.col(b)
            high = ((acc - low) / F.col(b)).cast("long")
            mixed = lambda v: (v % F.lit(PRIME) * factor + offset) % F.lit(PRIME)
            return F.when(i % 2 == 1, (high + mixed(low) * mixed(low) % F.lit(PRIME)) % F.col(a) * F.col(b) + low).otherwise(
                high * F.col(b) + (low + mixed(high) * mixed(high) % F.lit(PRIME)) % F.col(b)
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(len(keys))), x, step)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col(pos), lambda acc, _: F.when(acc < F.col(total), acc).otherwise(once(acc)))
    df = df.withColumn(pos, F.when(F.col(pos) < F.col(total), F.col(pos)).otherwise(walked))
    checked = F.when(F.col(pos) < F.col(total), F.col(pos)).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return df.withColumn(out, checked).drop(a, b, left, right, pos)


def shard_rows(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Adds row_number, position, shard and slot (long, long, int, long) to every row of df, whatever its other columns.

    Law `rows`: shard sizes differ by at most one. Null ids and texts, repeated rows and ties each get a number of
    their own; where df already has a column of one of these names, the new one replaces it.
    """
    df = df.drop("row_number", "position", "shard", "slot")
    crc, total = free_name(df, "_crc"), free_name(df, "_total")
    rows = numbered(df.withColumn(crc, text_crc32(F.col(text_col))), id_col, crc, "row_number", total)
    return (
        permuted(rows, "row_number", total, "position", seed)
        .withColumn("shard", (F.col("position") % F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"position div {int(shards)}"))
        .drop(crc, total)
    )


def op1_shards(documents: DataFrame) -> DataFrame:
    """The contract's columns for all documents. Equal texts share text_crc32; a null text has size 8 and CRC 0."""
    narrow = documents.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long").alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    rows = numbered(narrow, "doc_id", "text_crc32", "row_number", "_total", ("size",))
    return permuted(rows, "row_number", "_total", "position").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % F.lit(SHARDS)).cast("int").alias("shard"),
        F.expr(f"position div {SHARDS}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op1_sql() -> str:
    """The same law in DuckDB: CRC-32 byte by byte, bucket numbering, and the walk as a recursive query."""
    ctes = []
    for i, (factor, offset) in enumerate(round_keys(SEED)):
        mixed = lambda v, f=factor, o=offset: f"((({v}) % {PRIME} * {f} + {o}) % {PRIME})"
        if i % 2 == 0:
            m = mixed("r")
            expr_l, expr_r = f"(l + ({m} * {m}) % {PRIME}) % a", "r"
        else:
            m = mixed("l")
            expr_l, expr_r = "l", f"(r + ({m} * {m}) % {PRIME}) % b"
        ctes.append(f"(SELECT id, x0, n, a, b, {expr_l} AS l, {expr_r} AS r FROM {{}})")
    nested = "(SELECT id, x0, n, a, b, x // b AS l, x % b AS r FROM walk WHERE step = 0 OR x >= n)"
    for c in ctes:
        nested = c.format(nested)
    return f"""
    WITH RECURSIVE crc_table AS (
      SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) ORDER BY i) AS t
      FROM range(256) r(i)),
    docs AS (
      SELECT row_number() OVER () AS id, doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size,
        xor(list_reduce(list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT),
            lambda c, v: xor(c // 256, t[xor(c, v) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
      FROM documents, crc_table),
    bucketed AS (
      SELECT *, (((((coalesce(doc_id, -1) % {PRIME} + {PRIME}) % {PRIME}) * 48271 + text_crc32) % {PRIME}) * 69621 + 7) % {PRIME} % {BUCKETS} AS bucket FROM docs),
    numbered AS (
      SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS rn, count(*) OVER () AS n FROM bucketed),
    sides AS (SELECT *, ceil(sqrt(n))::BIGINT AS a FROM numbered),
    walk AS (
      SELECT id, rn AS x0, n, a, (n + a - 1) // a AS b, rn AS x, 0 AS step FROM sides
      UNION ALL
      SELECT id, x0, n, a, b, l * b + r AS x, 1 AS step FROM {nested}),
    placed AS (SELECT id, x FROM walk WHERE step = 1 AND x < n)
    SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INT AS shard, (x // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, rn AS row_number
    FROM placed JOIN numbered USING (id)
    """
