"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has a target of words by weight, no more than CAP times its own words. Its rows are dealt by hash into
about sqrt(rows) blocks. A source whose target is e whole passes and a rest draws every block e times, and once more
the blocks that fit into the rest, in an order given by hash; the next few blocks fill what is left row by row. The
numbers of block draws are the sources' quotas. A binary tree splits the quotas among the output shards: each node
sends half of its draws to the left, and how many of each source are among them is drawn from the multivariate
hypergeometric distribution, by inverting the hypergeometric one source by source (groups of sources first). A leaf
holds a shard's exact quota of each source; the shard then takes the next so many of the source's draws, whose blocks
are permuted by hash in each pass, so shards draw disjoint permuted blocks. In a shard, rows are ordered by hash.
Hashes come from a seed, ids and texts alone, so reruns agree. DataFrame functions only. Beside documents, tables hold
one row a source (ranked and summed in one task: millions of sources), or about CAP + 1 rows a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import BLANK_WORD, bound, forget, written

#: Fixed values of the contract: weights of the sources in order, repeating, and the most passes over a source.
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 7
#: Blocks at the edge of a source's last pass that are filled row by row.
EDGE_BLOCKS = 3
#: Levels of the tree: 2 ** LEVELS output shards.
LEVELS = 4
#: Sources that one fold draws for; their sums are drawn first, so no row holds more than this many or that many sums.
GROUP = 1000
#: Rounds of filling the edge: first by hash, then the largest that still fit.
EDGE_ROUNDS = 3
#: Pieces of an output shard that are shuffled locally, in order of out_order.
PIECE_BITS = 6


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def _unit(id_col: str, source_col: str, text_col: str) -> Column:
    """Rows equal in id, source and text are one unit, drawn together."""
    return F.xxhash64(F.col(id_col), F.col(source_col), F.lit("|"), F.col(text_col))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(src, source, rows, source_size, target) from (source, unit, size), one row for each source.

    Sources come by code point, null last, with weights 1, 2, 3, repeating. A target above CAP times the source's size
    stops there and its excess goes to the others by weight, until none is above: with the sources in the order of
    cap / weight, the first that stays below its cap fixes the level for all that follow.
    """
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    # from here on one row for each source
    by = by.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("src") - 1).cast("int") % len(WEIGHTS) + 1)
    by = by.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * CAP).cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")), "src")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(every).cast("double"))
    by = by.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("level", (F.col("total") - F.col("capped")) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", F.coalesce(F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(every), F.lit(0.0)))
    return by.select("src", "source", "rows", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


@dataclass(frozen=True)
class Plan:
    """targets: one row a source, with its number of blocks; quotas (src, shard, n); placed (src, block, passes, whole,
    shards), shards in the order of the draws; edge (src, unit): units of edge blocks that take part in the last draw."""

    targets: DataFrame
    quotas: DataFrame
    placed: DataFrame
    edge: DataFrame


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked ones among drawn of total, of which marked are, by inversion at the uniform u.

    Outcomes are taken from the mode upwards and then from the mode downwards, as far as ten standard deviations and
    ten: what lies beyond weighs less than a double can tell.
    """

    def within(s: Column) -> Column:
        high, mode, steps = s["high"], s["mode"], s["steps"]
        size, k, n = (s[c].cast("double") for c in ("total", "marked", "drawn"))
        up = high - mode

        def step(acc: Column, i: Column) -> Column:
            at = F.when(i <= up, acc["at"] + 1).when(i == up + 1, mode - 1).otherwise(acc["at"] - 1)
            x = at.cast("double")
            more = (k - x + 1) * (n - x + 1) / (x * (size - k - n + x))
            less = (x + 1) * (size - k - n + x + 1) / ((k - x) * (n - x))
            weight = F.when(i <= up, acc["weight"] * more).when(i == up + 1, less).otherwise(acc["weight"] * less)
            return bound(F.struct(at.alias("at"), weight.alias("weight")), lambda v: F.struct(
                v["at"].alias("at"), v["weight"].alias("weight"), (acc["sum"] + v["weight"]).alias("sum"),
                F.when(acc["found"].isNull() & (acc["sum"] + v["weight"] > acc["goal"]), v["at"]).otherwise(acc["found"]).alias("found"), acc["goal"].alias("goal"),
            ))

        turns = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>"))
        start = lambda goal: F.struct(mode.alias("at"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum"), F.when(goal < 1, mode).alias("found"), goal.alias("goal"))
        whole = F.aggregate(turns, start(F.lit(0.0)), step, lambda acc: acc["sum"])
        return bound(whole, lambda w: F.aggregate(turns, start(u * w), step, lambda acc: F.coalesce(acc["found"], mode)))

    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(drawn, marked)
    share = marked / F.greatest(total, F.lit(1).cast("long"))
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1) * ((marked + 1) / (total + 2)))))
    reach = F.ceil(10 * F.sqrt(drawn * share * F.greatest(1 - share, F.lit(0.0)))) + 10
    sides = F.struct(total.alias("total"), marked.alias("marked"), drawn.alias("drawn"), low.alias("low"), high.alias("high"), mode.alias("mode"), reach.alias("reach"))
    near = lambda s: F.struct(
        s["total"].alias("total"), s["marked"].alias("marked"), s["drawn"].alias("drawn"), s["mode"].alias("mode"), F.least(s["high"], s["mode"] + s["reach"]).alias("high"),
        (F.least(s["high"], s["mode"] + s["reach"]) - F.greatest(s["low"], s["mode"] - s["reach"])).alias("steps"),
    )
    return bound(sides, lambda s: bound(near(s), within))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def _drawn(seed: int) -> Column:
    """items (id, n) with x, how many of each are among half draws of all; columns items, half, node and tag."""
    items, node, tag = F.col("items"), F.col("node"), F.col("tag")
    start = F.struct(_sum(items).alias("total"), F.col("half").cast("long").alias("half"), F.array().cast("array<struct<id:bigint,n:bigint,x:bigint>>").alias("out"))

    def step(acc: Column, item: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), tag, node, item["id"]), 11) / float(1 << 53)
        return bound(hypergeometric(acc["total"], item["n"], acc["half"], u), lambda x: F.struct(
            (acc["total"] - item["n"]).alias("total"), (acc["half"] - x).alias("half"), F.array_append(acc["out"], F.struct(item["id"].alias("id"), item["n"].alias("n"), x.alias("x"))).alias("out"),
        ))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def _children(split: Column) -> tuple[Column, Column]:
    """The items of both sides of a node."""
    left = F.transform(split, lambda i: F.struct(i["id"].alias("id"), i["x"].alias("n")))
    right = F.transform(split, lambda i: F.struct(i["id"].alias("id"), (i["n"] - i["x"]).alias("n")))
    return tuple(F.filter(side, lambda i: i["n"] > 0) for side in (left, right))


def split_quotas(quotas: DataFrame, seed: int = SEED, levels: int = LEVELS) -> DataFrame:
    """(src, shard, n) from (src, n): the leaves of the splitting tree; nodes are numbered 1, then 2i and 2i + 1."""
    item = lambda i, n: F.sort_array(F.collect_list(F.struct(F.col(i).cast("long").alias("id"), F.col(n).cast("long").alias("n"))))
    groups = quotas.filter("n > 0").withColumn("grp", F.expr(f"(src - 1) div {GROUP}")).groupBy("grp").agg(item("src", "n").alias("items"), F.sum("n").alias("n"))  # GROUP sources at most
    leaf = (F.col("node") - (1 << levels)).cast("int")
    split = _drawn(seed)  # made once: columns of this size take the driver a while
    top, total = quotas.agg(F.max("src"), F.sum("n")).first()
    if top is None or top <= GROUP:
        # one group: all of its draws are each half's, so its tree is halving alone
        sums = groups.select("grp", F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(n).cast("long").alias("n")) for i, n in enumerate(_halved(total or 0, levels))]).alias("sums"))
    else:
        nodes = groups.agg(item("grp", "n").alias("items")).withColumn("node", F.lit(1).cast("long"))
        half = F.expr("(aggregate(items, 0L, (a, x) -> a + x.n) + 1) div 2")
        for _ in range(levels):
            nodes = _next(nodes.select("node", "items", half.alias("half"), F.lit("groups").alias("tag")).select("node", split.alias("split")), [])
        sums = nodes.select(leaf.alias("shard"), F.explode("items").alias("i")).groupBy(F.col("i.id").alias("grp")).agg(F.collect_list(F.struct("shard", F.col("i.n").alias("n"))).alias("sums"))
    nodes = groups.select("grp", "items", F.lit(1).cast("long").alias("node")).join(sums, "grp")
    for level in range(levels):
        # what the groups' tree sent to the left of this node is known: the sums of the shards below its left child
        width = 1 << (levels - level - 1)
        first = (F.col("node") * 2 - (1 << (level + 1))) * width
        below = F.filter("sums", lambda s: (s["shard"] >= first) & (s["shard"] < first + width))
        nodes = nodes.select("grp", "sums", "node", "items", _sum(below).alias("half"), F.lit("sources").alias("tag"))
        nodes = _next(nodes.select("grp", "sums", "node", split.alias("split")), ["grp", "sums"])
    return nodes.select(leaf.alias("shard"), F.explode("items").alias("i")).select(F.col("i.id").alias("src"), "shard", F.col("i.n").alias("n"))


def _halved(total: int, levels: int) -> list[int]:
    """Draws of each leaf: a node's left half is the larger one."""
    out = [total]
    for _ in range(levels):
        out = [x for n in out for x in ((n + 1) // 2, n // 2)]
    return out


def _next(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Two rows for each node that was split, of its children."""
    left, right = _children(F.col("split"))
    both = F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("items")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("items")))
    return nodes.select(*keep, F.explode(both).alias("child")).select(*keep, "child.node", "child.items")


def _edge_units(edge: DataFrame) -> DataFrame:
    """(src, unit) that fill the room of their source: (src, unit, size, room), 3 * sqrt(rows) units of a source.

    By hash as long as they fit; then, for a few rounds, the largest of those that still fit; at last the smallest
    left over, if that comes nearer to the target.
    """
    rows = edge.withColumn("took", F.lit(False))
    of = Window.partitionBy("src")
    for turn in range(EDGE_ROUNDS):
        order = of.orderBy("open", *([F.xxhash64("unit")] if not turn else [F.desc("size")]), "unit").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("open", F.col("took") | (F.col("size") > F.col("room")))  # false comes first
        rows = rows.withColumn("upto", F.sum(F.when(~F.col("open"), F.col("size"))).over(order))
        now = ~F.col("open") & (F.col("upto") <= F.col("room"))
        rows = rows.withColumn("now", now).withColumn("room", F.col("room") - F.coalesce(F.max(F.when(F.col("now"), F.col("upto"))).over(of), F.lit(0)))
        rows = rows.withColumn("took", F.col("took") | F.col("now"))
    spare = F.min(F.when(~F.col("took"), F.struct("size", "unit"))).over(of)
    rows = rows.withColumn("spare", spare)
    last = (F.col("spare.unit") == F.col("unit")) & (F.col("spare.size") - F.col("room") < F.col("room"))
    return rows.filter(F.col("took") | F.coalesce(last, F.lit(False))).select("src", "unit")


def mix_plan(sizes: DataFrame, seed: int = SEED, levels: int = LEVELS) -> Plan:
    """The plan of a mix of rows (source, unit, size)."""
    known = source_targets(sizes)
    known = known.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(CAP))).otherwise(0).cast("int"))
    known = known.withColumn("rest", F.when(F.col("passes") < CAP, F.round(F.col("target") - F.col("passes") * F.col("source_size"))).otherwise(0).cast("long"))
    known = written(known.withColumn("blocks", F.ceil(F.sqrt(F.col("rows"))).cast("long")), "targets")
    units = _in_blocks(sizes, known, "source", "unit")

    # about sqrt(rows) blocks for each source, in an order given by hash
    sums = units.groupBy("src", "block").agg(F.sum("size").alias("words")).join(known.select("src", "passes", "rest"), "src")
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "src", "block"), "block")
    blocks = sums.withColumn("upto", F.sum("words").over(order)).withColumn("turn", F.row_number().over(order))
    blocks = blocks.withColumn("whole", F.col("upto") <= F.col("rest"))
    every = Window.partitionBy("src")
    # the words that blocks taken whole leave, and the turn of the first block beyond them
    blocks = blocks.withColumn("room", F.col("rest") - F.coalesce(F.max(F.when(F.col("whole"), F.col("upto"))).over(every), F.lit(0)))
    blocks = blocks.withColumn("edge", F.min(F.when(~F.col("whole"), F.col("turn"))).over(every))
    at_edge = ~F.col("whole") & (F.col("turn") < F.col("edge") + EDGE_BLOCKS) & (F.col("room") > 0)
    blocks = written(blocks.select("src", "block", "passes", "turn", "whole", F.when(at_edge, F.col("room")).alias("room")), "blocks")
    edge = units.join(blocks.filter("room IS NOT NULL").select("src", "block", "room"), ["src", "block"]).groupBy("src", "unit", "room").agg(F.sum("size").alias("size"))
    edge = written(_edge_units(edge), "edge-units")

    # the quotas: passes draws of each block, and one more of a block that is taken whole or lies at the edge
    n_draws = F.col("passes") + F.when(F.col("whole") | F.col("room").isNotNull(), 1).otherwise(0)
    wanted = written(blocks.groupBy("src").agg(F.sum(n_draws).alias("n")), "draws")
    quotas = written(split_quotas(wanted, seed, levels), "quotas")
    upto = F.sum("n").over(Window.partitionBy("src").orderBy("shard"))  # 2 ** levels rows a source
    ends = quotas.withColumn("upto", upto).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("ends"))
    draws = blocks.withColumn("draw", F.explode(F.sequence(F.lit(1), n_draws + 1))).filter(F.col("draw") <= n_draws)
    # each pass permutes the blocks anew; whole passes come first
    turn = F.row_number().over(Window.partitionBy("src").orderBy("draw", F.when(F.col("draw") > F.col("passes"), F.col("turn").cast("long")).otherwise(F.xxhash64(F.lit(seed), "draw", "src", "block")), "block"))
    shard = F.element_at(F.filter("ends", lambda e: e["upto"] >= F.col("j")), 1)["shard"]
    placed = draws.withColumn("j", turn).join(ends, "src").select("src", "block", "passes", "whole", "draw", shard.alias("shard"))
    placed = placed.groupBy("src", "block", "passes", "whole").agg(F.sort_array(F.collect_list(F.struct("draw", "shard"))).alias("s"))  # at most CAP + 1 entries
    placed = written(placed.select("src", "block", "passes", "whole", F.transform("s", lambda x: x["shard"]).alias("placed")), "placed")
    forget(blocks)
    return Plan(known, quotas, placed, edge)


def _in_blocks(df: DataFrame, targets: DataFrame, source: str, unit: str) -> DataFrame:
    """df with src and block."""
    named = targets.select("src", F.col("source").alias("_source"), "blocks")
    return df.join(named, F.col(source).eqNullSafe(F.col("_source"))).withColumn("block", F.pmod(F.col(unit), F.col("blocks"))).drop("_source", "blocks")


def _with_shards(df: DataFrame, plan: Plan, unit: str) -> DataFrame:
    """df with shards, the output shards of each row's draws, and n_draws; df has src and block."""
    edge = plan.edge.select("src", F.col("unit").alias(unit), F.lit(True).alias("_edge"))
    out = df.join(plan.placed, ["src", "block"], "left").join(edge, ["src", unit], "left")
    n = F.coalesce(F.col("passes") + F.when(F.col("whole") | F.coalesce("_edge", F.lit(False)), 1).otherwise(0), F.lit(0))
    shards = F.when(n > 0, F.slice("placed", F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return out.withColumn("shards", shards).withColumn("n_draws", n).drop("placed", "passes", "whole", "_edge")


def _sizes(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(source_col).alias("source"), _unit(id_col, source_col, text_col).alias("unit"), n_words(F.col(text_col)).alias("size"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, levels: int = LEVELS) -> DataFrame:
    """The drawn rows of df, whole: each as often as it is drawn (up to CAP times), with out_shard and out_order.

    Rows come dealt to partitions by output shard and sorted by out_order, so files written from them hold the mix in
    its order. Rows are never cut. A null source is a source, last in order. Null texts have size 0. Rows equal in id,
    source and text are drawn together. An empty table gives an empty table. Columns named out_shard or out_order are
    replaced.
    """
    sizes = written(_sizes(df, id_col, source_col, text_col), "sizes")
    plan = mix_plan(sizes, seed, levels)
    forget(sizes)
    # df's own columns travel as one struct, so no name of theirs can clash
    rows = df.drop("out_shard", "out_order").select(F.struct("*").alias("_row"), F.col(source_col).alias("_from"), _unit(id_col, source_col, text_col).alias("_unit"))
    rows = _with_shards(_in_blocks(rows, plan.targets, "_from", "_unit"), plan, "_unit").filter("n_draws > 0")
    rows = rows.select("_row", "_unit", F.posexplode("shards").alias("draw", "out_shard"))
    rows = rows.withColumn("out_order", F.xxhash64(F.lit(seed), "out_shard", "_unit", "draw"))
    piece = F.shiftright("out_order", 64 - PIECE_BITS)
    return rows.repartition("out_shard", piece).sortWithinPartitions("out_shard", "out_order").select("_row.*", "out_shard", "out_order")


def op10_mix(documents: DataFrame) -> DataFrame:
    """The contract's columns, n_draws and out_shards for all documents; taken is size times the number of draws."""
    rows = written(documents.select("doc_id", "source", _unit("doc_id", "source", "text").alias("unit"), n_words(F.col("text")).alias("size")), "sizes")
    plan = mix_plan(rows.select("source", "unit", "size"))
    out = _with_shards(_in_blocks(rows, plan.targets, "source", "unit"), plan, "unit").join(plan.targets.select("src", "source_size", "target"), "src")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_draws")).alias("taken"), "n_draws", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("out_shards"))


def mix_targets(documents: DataFrame) -> DataFrame:
    """One row a source: its size, and the target that the mix aims at."""
    return source_targets(_sizes(documents, "doc_id", "source", "text")).select("source", "rows", "source_size", F.round("target", 6).alias("target"))


def mix_targets_sql() -> str:
    """The targets by as many rounds of resharing as there are sources."""
    return f"""
    WITH RECURSIVE s AS (SELECT source, count(*) AS rows, sum(len(regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}')))::BIGINT AS source_size FROM documents GROUP BY source),
    w AS (SELECT *, [{', '.join(f'{w}e0' for w in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight, sum(source_size) OVER ()::DOUBLE AS total, count(*) OVER () AS n FROM s),
    r AS (
      SELECT 0 AS round, source, rows, source_size, weight, n, total AS free, FALSE AS full_, sum(weight) OVER () AS open_weight FROM w
      UNION ALL
      SELECT round + 1, source, rows, source_size, weight, n, free - sum(CASE WHEN now THEN {CAP} * source_size ELSE 0 END) OVER (), full_ OR now, sum(CASE WHEN full_ OR now THEN 0 ELSE weight END) OVER ()
      FROM (SELECT *, NOT full_ AND free * weight / open_weight > {CAP} * source_size AS now FROM r) WHERE round < n)
    SELECT source, rows, source_size, round(CASE WHEN full_ THEN {CAP}e0 * source_size ELSE free * weight / open_weight END, 6) AS target FROM r WHERE round = n
    """
