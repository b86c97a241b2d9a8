"""Tamper-evident tables: a tree of hashes over fixed ranges of a key, so a change is found and named by its range.

A leaf is the hash of its rows in order; the key's value alone says which leaf a row is in, so files and partitions do
not matter. A node is the hash of its children. Checking a copy compares roots first, then only the nodes that differ,
and reads again the ranges that they lead to and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.geometry import double_hex

#: Key values of a leaf, and children of a node.
RANGE, FAN = 1024, 16


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row: names, types and values in name order, doubles by their bits, nulls apart from empty texts."""
    parts = []
    for name, kind in sorted(df.dtypes):
        value = F.col(f"`{name}`")
        if kind in ("double", "float"):
            value = double_hex(value.cast("double"))
        elif kind == "binary":
            value = F.hex(value)
        elif kind.startswith("timestamp"):
            value = F.unix_micros(value.cast("timestamp"))
        elif kind.startswith(("array", "map", "struct")):
            value = F.to_json(F.struct(value))
        text = value.cast("string")
        # a length before each value, so that no two rows read the same
        parts.append(F.coalesce(F.concat(F.lit(f"{name}:{kind}="), F.length(text).cast("string"), F.lit(":"), text), F.lit(f"{name}:{kind}?")))
    return F.sha2(F.concat_ws(";", *parts), 256)


def tree(df: DataFrame, key: str, span: int = RANGE, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """(level, node, n, hash): leaves (level 0) of span key values each, and their parents up to one root for each sign,
    or as many levels of parents as levels says.

    key is a whole number; rows without one are in the leaf of the least number. Rows of one key are ordered by their
    digests, and rows that repeat count as often as they do. A leaf holds the rows of span key values; the levels above
    have one row for fan rows below. No rows give no tree.
    """
    least = -(2**63)
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("_k"), row_digest(df).alias("_h"))
    leaf = rows.groupBy(F.floor(F.col("_k") / span).cast("long").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda r: r["_h"]), ",").alias("_all"))
    level = leaf.select(F.lit(0).alias("level"), "node", "n", F.sha2("_all", 256).alias("hash"))
    out, depth = level, 0
    low, high = df.agg(F.min(F.coalesce(F.col(key).cast("long"), F.lit(least))), F.max(F.coalesce(F.col(key).cast("long"), F.lit(least)))).first()
    while depth < levels if levels is not None else low is not None and low // span // fan**depth != high // span // fan**depth and depth < 64:
        depth += 1
        up = level.groupBy(F.floor(F.col("node") / fan).cast("long").alias("node")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("_all"))
        level = up.select(F.lit(depth).alias("level"), "node", "n", F.sha2(F.array_join(F.transform("_all", lambda r: F.concat_ws(":", r["node"].cast("string"), r["hash"])), ","), 256).alias("hash"))
        out = out.unionByName(level)
    return out


def changed_ranges(kept: DataFrame, now: DataFrame, span: int = RANGE, fan: int = FAN) -> DataFrame:
    """(first, last) key values of the leaves that differ between two trees, in order.

    From the top down, only children of nodes that differ are looked at; where trees have no node in common, all leaves
    of either are.
    """
    both = kept.select("level", "node", F.col("hash").alias("_old")).join(now.select("level", "node", F.col("hash").alias("_new")), ["level", "node"], "full")
    top = both.agg(F.max("level")).first()[0]
    if top is None:
        return both.select(F.col("node").alias("first"), F.col("node").alias("last"))
    shared = kept.agg(F.max("level")).first()[0] == now.agg(F.max("level")).first()[0]
    differ = both.filter(~F.col("_old").eqNullSafe(F.col("_new")))
    if shared:
        suspect = differ.filter(F.col("level") == top).select("node")
        for level in range(top - 1, -1, -1):
            children = differ.filter(F.col("level") == level).withColumn("_up", F.floor(F.col("node") / fan).cast("long"))
            suspect = children.join(suspect.select(F.col("node").alias("_up")), "_up", "left_semi").select("node")
    else:
        suspect = differ.filter("level = 0").select("node")
    return suspect.select((F.col("node") * span).alias("first"), (F.col("node") * span + span - 1).alias("last")).orderBy("first")


def rows_of(df: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """The rows of df whose key is in one of the ranges; each range is one leaf, so its number joins."""
    span = F.col("last") - F.col("first") + 1
    width = ranges.select(span.alias("s")).limit(1).first()
    if width is None:
        return df.limit(0)
    nodes = ranges.select(F.expr(f"first div {width[0]}").alias("_node"))
    return df.withColumn("_node", F.floor(F.col(key).cast("long") / width[0]).cast("long")).join(nodes, "_node", "left_semi").drop("_node")
