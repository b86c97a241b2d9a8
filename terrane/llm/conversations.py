"""A prefix trie of conversations, its subtrees as intervals of a preorder.

A node is a distinct sequence of first turns; its digest is the exclusive-or of hashes of (depth, turn), so all digests
of a conversation come from one running scan, whatever its length. Each node is owned by the smallest conversation
that starts with it; what a conversation owns is one path downward, hung below a node of a smaller one. The path's
lexicographic key is the list of (depth, conversation) at which owners change on the way from the root, and a node's
key is its path's key with its own depth. In that order every subtree is one interval, and all nodes of a path end
with the path. Nodes and ends of paths are sorted by key over all tasks, leaves and savings are summed along the
order, and a subtree's sum is the difference between its end and its start.

No task holds a conversation, a node's members or a node's children as a group: scans cross tasks, joins on hot keys
are split, and lists of members are joined into pieces where they are sorted. The hash of a node's list of ends is
sequential by nature; its pieces pass through one task one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import BLANKS, forget, written
from terrane.llm.scan import running
from terrane.sources.ship import ship_package

#: Base conversations are those whose id is a multiple; at most SHARED - 1 of their turns are taken over.
FAMILY, SHARED = 20, 4
#: Turns of a conversation, or nodes of a path, that one key of a join holds.
BLOCK = 65536
#: Keys with more rows than the larger of these are joined by broadcast; they are HEAVY_KEYS at most.
HEAVY_ROWS, HEAVY_KEYS = 256, 20_000
#: Decimal ids that one piece of a list of ends holds.
PIECE = 4096
#: Greater than any depth: the end of a path.
END = 1 << 62
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def joined_by_hot_key(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows left joined with table, which has one row for each key; both are written tables.

    A key of very many rows would land in one task, so such keys' rows of table are broadcast: no more than HEAVY_KEYS
    keys can have over rows / HEAVY_KEYS rows.
    """
    limit = max(HEAVY_ROWS, rows.count() // HEAVY_KEYS)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).drop("_n")
    hot = table.join(hot, keys, "left_semi").withColumn("_hot", F.lit(True))
    tried = rows.join(F.broadcast(hot), keys, "left")
    some = tried.filter("_hot").drop("_hot")
    rest = tried.filter("_hot IS NULL").select(*rows.columns)
    return some.unionByName(rest.join(table, keys, "left"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, i, x1, x2, words), written: turn i of each conversation, from 1, its 128-bit digest and its words.

    Turns are ordered by turn, null first; ties by role, then by the MD5 of the text. A null role or text counts as
    empty. Rows without a conv_id belong to no conversation.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")
    plain = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.md5(text).alias("digest"),
        words.alias("words"), F.lit(1).cast("long").alias("i"),
    )
    scanned = running(plain, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "conv", sums=("i",), name="turns")
    out = scanned.select("conv", F.col("run_i").alias("i"), F.xxhash64("role", "digest").alias("x1"), F.xxhash64(F.lit(1), "role", "digest").alias("x2"), "words")
    out._written_path = scanned._written_path
    return out


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): conv, its number of turns `length`; and conv, depth, h1, h2, words of every rebuilt turn.

    Conversation c gets the first h turns of c - c % family and its own turns after its first h, h = crc32(c) % shared.
    """
    h = (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % shared).alias("h")
    convs = turns.groupBy("conv").agg(F.max("i").alias("n")).select("conv", "n", h, (F.col("conv") - F.col("conv") % family).alias("base"))
    convs = written(convs, "conversations")
    bases = convs.filter("conv = base").select("base", F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    known = convs.join(bases, "base", "left").select("conv", "base", "n", "h", taken.alias("taken"))
    known = written(known.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    forget(convs)

    block = F.expr(f"i div {BLOCK}")
    blocks = known.select("conv", (F.col("taken") - F.col("h")).alias("shift"), "h", F.explode(F.expr(f"sequence(0L, n div {BLOCK})")).alias("block"))
    own = turns.withColumn("block", block).join(blocks, ["conv", "block"]).filter("i > h").select("conv", (F.col("i") + F.col("shift")).alias("depth"), "x1", "x2", "words")
    heads = turns.filter(f"i < {shared} AND conv % {family} = 0").withColumnRenamed("conv", "base")
    front = known.filter("taken > 0").select("conv", "base", "taken").join(heads, "base").filter("i <= taken").select("conv", F.col("i").alias("depth"), "x1", "x2", "words")
    rows = own.unionByName(front)
    return known, rows.select("conv", "depth", F.xxhash64("depth", "x1", "x2").alias("h1"), F.xxhash64(F.lit(1), "depth", "x1", "x2").alias("h2"), "words")


def trie_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes, written: depth, p1, p2 (digest), owner, n_convs, words, n_children, above (the parent's owner).

    rows are (conv, depth, p1, p2, h1, h2, words), a turn each, and convs (conv) all conversations.
    """
    made = rows.groupBy("depth", "p1", "p2").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), *[F.first(c).alias(c) for c in ("words", "h1", "h2")])
    nil = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(nil.alias("depth"), nil.alias("p1"), nil.alias("p2"), "owner", "n_convs", *[nil.alias(c) for c in ("words", "h1", "h2")])
    nodes = written(made.unionByName(root), "nodes")
    up = [(F.col("depth") - 1).alias("up_depth"), F.col("p1").bitwiseXOR(F.col("h1")).alias("up1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("up2")]
    kids = nodes.select(*up).groupBy("up_depth", "up1", "up2").agg(F.count(F.lit(1)).alias("n_children"))
    kids = kids.select(F.col("up_depth").alias("depth"), F.col("up1").alias("p1"), F.col("up2").alias("p2"), "n_children")
    known = nodes.join(kids, ["depth", "p1", "p2"], "left").select("depth", "p1", "p2", "owner", "n_convs", "words", F.coalesce("n_children", nil).alias("n_children"), *up)
    known = written(known, "nodes")
    forget(nodes)
    parents = known.filter("n_children > 0").select(F.col("depth").alias("up_depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("owner").alias("above"))
    out = written(joined_by_hot_key(known, parents, ["up_depth", "up1", "up2"]).drop("up_depth", "up1", "up2"), "nodes")
    forget(known)
    return out


def path_keys(nodes: DataFrame) -> DataFrame:
    """(owner, key, top, bottom), written: each path with its lexicographic key and the depths it goes from and to.

    A path hangs below another one; keys are put together by doubling, so rounds grow with the logarithm of the number
    of owners between a path and the root. A key has three numbers for each of them.
    """
    hung = F.col("above").isNull() | (F.col("above") != F.col("owner"))
    ends = nodes.groupBy("owner").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.max(F.when(hung, F.col("above"))).alias("above"))
    key = F.when(F.col("above").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("top", F.lit(0).cast("long"), "owner"))
    state = written(ends.select("owner", "top", "bottom", "above", key.alias("key")), "paths")
    while not state.filter("above IS NOT NULL").isEmpty():
        upper = state.select(F.col("owner").alias("above"), F.col("above").alias("next"), F.col("key").alias("upper"))
        moving = state.filter("above IS NOT NULL")
        moved = joined_by_hot_key(moving, upper, ["above"]).select("owner", "top", "bottom", F.col("next").alias("above"), F.concat("upper", "key").alias("key"))
        step = written(moved.unionByName(state.filter("above IS NULL")), "paths")
        forget(state)
        state = step
    return state.drop("above")


def preordered(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes with `preorder`, `subtree_end` (number after the last node of the subtree), n_leaves and saved_tokens."""
    block = F.explode(F.expr(f"sequence(top div {BLOCK}, bottom div {BLOCK})")).alias("block")
    own = F.expr(f"depth div {BLOCK}")
    nil, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    leaf = F.when(F.col("n_children") == 0, one).otherwise(nil)
    held = nodes.withColumn("block", own).join(paths.select("owner", "key", block), ["owner", "block"])
    held = held.select(
        F.concat("key", F.array(F.col("depth"), one)).alias("key"), "owner", "depth", "p1", "p2", "above", "n_convs", "n_children", one.alias("node"), leaf.alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), nil.alias("top"), nil.alias("bottom"),
    )
    ends = paths.select(
        F.concat("key", F.array(F.lit(END), nil)).alias("key"), "owner", *[nil.alias(c) for c in ("depth", "p1", "p2")], F.lit(None).cast("long").alias("above"),
        *[nil.alias(c) for c in ("n_convs", "n_children", "node", "leaf", "saved")], "top", "bottom",
    )
    ranked = running(held.unionByName(ends), [F.col("key")], sums=("node", "leaf", "saved"), name="preorder")
    last = ranked.filter("node = 0").select("owner", block, *[F.col(f"run_{c}").alias(f"end_{c}") for c in ("node", "leaf", "saved")])
    found = ranked.filter("node = 1").withColumn("block", own).join(last, ["owner", "block"])
    sums = [(F.col(f"end_{c}") - F.col(f"run_{c}") + F.col(c)).alias(name) for c, name in (("leaf", "n_leaves"), ("saved", "saved_tokens"))]
    return found.select("depth", "p1", "p2", "owner", "above", "n_convs", "n_children", (F.col("run_node") - 1).alias("preorder"), F.col("end_node").alias("subtree_end"), *sums)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, p1, p2, conv) as comma-joined pieces of one node's ids, none of them longer than PIECE ids."""
    at, ids, out = None, [], []

    def cut() -> None:
        if ids:
            out.append((*at, ids[0], len(ids), ",".join(map(str, ids))))
            ids.clear()

    def made() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 6
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], ["depth", "p1", "p2", "first", "n", "ids"])

    for batch in batches:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at or len(ids) >= PIECE:
                cut()
                at = key
            ids.append(conv)
        if len(out) > 512:
            yield made()
    cut()
    yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order."""
    at, digest, out = None, None, []
    for batch in batches:
        for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key == at:
                digest.update(b"," + ids.encode())
                continue
            if at is not None:
                out.append((*at, digest.hexdigest()))
            at, digest = key, hashlib.sha256(ids.encode())
        yield _digests(out)
        out = []
    if at is not None:
        yield _digests([(*at, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["depth", "p1", "p2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of rows (depth, p1, p2, conv): the hash of each node's ids in order, comma-joined."""
    node = ["depth", "p1", "p2"]
    ship_package(ends.sparkSession)
    pieces = ends.repartitionByRange(*node, "conv").sortWithinPartitions(*node, "conv").mapInArrow(_pieces, "depth long, p1 long, p2 long, first long, n long, ids string")
    dealt = pieces.repartition(*node).sortWithinPartitions(*node, "first").select(*node, "ids")
    return dealt.mapInArrow(_hashed, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text), one row for each node.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    preorder and subtree_end; all long but for the hash. Turns are ordered by turn (null first), ties by role and the
    MD5 of the text; null roles and texts are empty; rows that repeat all of it are turns of their own. Rows without a
    conv_id are left out. A conversation without a turn after rebuilding is a member of the root alone. Without
    conversations there is no node. Other columns are not read.
    """
    turns = numbered_turns(conversations)
    convs, rows = rebuilt(turns, family, shared)
    scanned = running(rows, [F.col("depth")], "conv", xors=("h1", "h2"), name="prefixes")
    forget(turns)
    rows = scanned.select("conv", "depth", F.col("run_h1").alias("p1"), F.col("run_h2").alias("p2"), "h1", "h2", "words")
    nodes = trie_nodes(rows, convs)
    last = rows.groupBy("conv").agg(F.max(F.struct("depth", "p1", "p2")).alias("at")).select("at.*", "conv")
    nil = F.lit(0).cast("long")
    ends = written(last.unionByName(convs.filter("length = 0").select(nil.alias("depth"), nil.alias("p1"), nil.alias("p2"), "conv")), "ends")
    forget(scanned)
    forget(convs)
    paths = path_keys(nodes)
    placed = preordered(nodes, paths)
    forget(nodes)
    forget(paths)
    out = placed.join(end_digests(ends), ["depth", "p1", "p2"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "preorder", "subtree_end",
    )


def op12_trie(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations).drop("preorder", "subtree_end")


def op12_sql() -> str:
    """Prefixes as lists, subtrees by comparing lists, in DuckDB."""
    return r"""
    WITH crc_table AS (
      SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) ORDER BY i) AS t FROM range(256) r(i)),
    original AS (
      SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    shared AS (
      SELECT conv_id, turns, conv_id - conv_id % 20 AS base,
        xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda c, v: xor(c // 256, t[xor(c, v) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
      FROM original, crc_table),
    rebuilt AS (
      SELECT s.conv_id, list_concat(coalesce(o.turns[1 : s.h], []), s.turns[s.h + 1 :]) AS turns FROM shared s LEFT JOIN original o ON o.conv_id = s.base),
    prefixes AS (SELECT conv_id, d AS depth, turns[1 : d] AS p, len(turns) = d AS ends FROM rebuilt, unnest(range(0, len(turns) + 1)) r(d)),
    nodes AS (
      SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
        CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[-1].text, '[^\x20\x09-\x0D]+')) END AS saved
      FROM prefixes GROUP BY depth, p),
    kids AS (SELECT depth - 1 AS depth, p[1 : depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    known AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.p = n.p),
    below AS (
      SELECT a AS depth, p[1 : a] AS p, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
      FROM known, unnest(range(0, depth + 1)) r(a) GROUP BY ALL)
    SELECT k.conv_id, k.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
      b.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
    FROM known k JOIN below b ON b.depth = k.depth AND b.p = k.p LEFT JOIN nodes up ON up.depth = k.depth - 1 AND up.p = k.p[1 : k.depth - 1]
    """
