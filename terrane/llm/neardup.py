"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A sketch has COORDS coordinates. In round r each shingle of the set is hashed once; the hash names a bin and a value,
and a coordinate keeps the least value of the first round that reaches it. After COORDS such rounds, round COORDS + j
hashes every shingle into bin j alone, so every coordinate fills; a set of n shingles needs about
COORDS * ln(COORDS) / n rounds, and the share of equal coordinates is concentrated about the Jaccard similarity.

Documents with equal sets form one class, of which one row goes on. Classes that agree on a band (four coordinates)
meet in a bucket. In each bucket a class is compared with the bucket's leader only; classes that turn out linked are
one component, and buckets that still hold several components try other leaders for a few turns. So a bucket of
thousands of copies costs about as many comparisons as it has members.

What is left is classes that share a bucket and are not linked so far, a page template's for example. They meet anew
by their rarest shingles: of two sets that reach the threshold, the shorter one's first (1 - 2t / (1 + t)) n + 1
shingles and the longer one's first (1 - t) n + 1, rarest first, have one in common. Sets that share a large common
part and differ too much in the rest share none of these and never meet; what does meet is compared block by block.
This step is exact whatever the order of the shingles is; their counts decide speed alone. A comparison first needs
sizes that allow the threshold and 128-bit sketches that do not rule it out (max_bits=None turns that off), and then
the full shingle sets, made again from whole texts.

Misses: two sets at similarity 0.75 share no band with probability (1 - 0.75 ** 4) ** 32 = 5e-6, and at 0.9 less than
1e-14; the sketch test turns down a pair at 0.75 with probability below 1e-8.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import arrow_pass, forget, texts_as_bytes, written
from terrane.sources.ship import ship_package

SHINGLE_WORDS = 5
PERCENT = 75


def _ratio_up(n: Column, up: int, down: int) -> Column:
    """n * up / down, rounded up, in whole numbers."""
    above = n * up + (down - 1)
    return ((above - F.pmod(above, F.lit(down))) / down).cast("long")


@dataclass(frozen=True)
class Rule:
    """Which documents are linked: 100 * intersection >= percent * union of their sets of `words`-word shingles."""

    words: int = SHINGLE_WORDS
    percent: int = PERCENT

    def probe(self, n: Column) -> Column:
        """Of n shingles in any order, so many from the start hold one that a linked set of n or fewer is looked up by."""
        return n - _ratio_up(n, self.percent, 100) + 1

    def index(self, n: Column) -> Column:
        """So many a set is looked up by where the other one has no fewer: the two share 2t / (1 + t) of it at least."""
        return n - _ratio_up(n, 2 * self.percent, 100 + self.percent) + 1


COORDS = 128
BAND = 4
BANDS = COORDS // BAND
#: Differing bits, of 128, beyond which a pair is not compared: 16 are expected at similarity 0.75. None compares all.
MAX_BITS = 40
#: Most turns of comparing with leaders before what is left is compared block by block; results do not depend on it.
TURNS = 3
#: Most rows of one block of a bucket where sizes and sketches alone are compared.
PARTNER_ROWS = 4000
#: Most rows and shingles of one block of a bucket.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 500_000
#: Most classes of a family that are compared all with all, in one group.
FAMILY_ROWS = 200
WORD_CACHE = 50_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.array([(_STEP * (i + 1)) % 2**64 for i in range(2 * COORDS)], np.uint64))
_BAND_SEEDS = _mix(np.array([(_STEP * (i + 1001)) % 2**64 for i in range(BANDS)], np.uint64))


class _Words(dict):
    """Hash of each word, kept for the next text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of so many words; of the whole sequence, where there are fewer words."""
    words = text.lower().split() if text else []  # of bytes: A-Z alone, and the six ASCII blanks alone
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    k = min(n, size)
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out = out * _FACTOR + h[j : n - k + 1 + j]
    return np.unique(_mix(out + np.uint64(k)))


def sketch(x: np.ndarray) -> np.ndarray:
    """COORDS coordinates of a non-empty set of hashes."""
    n = len(x)
    out, full = np.zeros(COORDS, np.uint64), np.zeros(COORDS, bool)
    at, step = 0, max(1, -(-800 // n))
    while at < COORDS:
        rounds = np.arange(at, min(at + step, COORDS), dtype=np.uint64)
        h = _mix(x[None, :] + _SEEDS[rounds][:, None])
        # by bin, then round, then value: the first of a bin is its coordinate
        key = (h & np.uint64(COORDS - 1)) << np.uint64(57) | rounds[:, None] << np.uint64(50) | h >> np.uint64(14)
        key = np.sort(key, axis=None)
        bins = (key >> np.uint64(57)).astype(np.intp)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        new = first[~full[bins[first]]]
        out[bins[new]] = key[new]
        full[bins[new]] = True
        if full.all():
            return out
        at += step
    for j in np.flatnonzero(~full):
        out[j] = _mix(x + _SEEDS[COORDS + j]).min()
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _signature_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingles(t) for t in texts_as_bytes(batch.column(1))]
    rows = np.zeros((len(sets), COORDS), np.uint64)
    digest = np.zeros((len(sets), 2), np.int64)
    for i, x in enumerate(sets):
        if len(x):
            rows[i] = sketch(x)
            digest[i] = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
    grouped = rows.reshape(len(sets), BANDS, BAND)
    bands = np.zeros((len(sets), BANDS), np.uint64) + _BAND_SEEDS[None, :]
    for j in range(BAND):
        bands = _mix(bands * _FACTOR + grouped[:, :, j])
    bits = np.packbits((_mix(rows) >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64).reshape(len(sets), 2)
    sizes = np.array([len(x) for x in sets], np.int64)
    offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(sizes), *(pa.array(np.ascontiguousarray(digest[:, j])) for j in (0, 1)), *(pa.array(np.ascontiguousarray(bits[:, j])) for j in (0, 1)), pa.ListArray.from_arrays(offsets, pa.array(_signed(bands).ravel()))],
        ["id", "n", "h1", "h2", "b1", "b2", "bands"],
    )


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, h1, h2, b1, b2, bands): set size, set digest, 128-bit sketch and band hashes of every row."""
    return arrow_pass(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), _signature_batch, "id long, n long, h1 long, h2 long, b1 long, b2 long, bands array<long>")


def _linked_batch(batch: pa.RecordBatch, rule: Rule) -> pa.RecordBatch | None:
    """Pairs (u, v) whose full shingle sets reach the threshold. Rows come sorted by u, so its set is made once."""
    us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    held, left, keep = None, None, []
    for i, (tu, tv) in enumerate(zip(texts_as_bytes(batch.column(2)), texts_as_bytes(batch.column(3)))):
        if tu != held:
            held, left = tu, shingles(tu, rule.words)
        right = shingles(tv, rule.words)
        both = len(np.intersect1d(left, right, assume_unique=True))
        if 100 * both >= rule.percent * (len(left) + len(right) - both) and both:
            keep.append(i)
    return pa.RecordBatch.from_arrays([pa.array([us[i] for i in keep], pa.int64()), pa.array([vs[i] for i in keep], pa.int64())], ["u", "v"])


def linked(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) that the full sets of texts (id, text) confirm, written."""
    with_v = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v")
    both = with_v.join(texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u").select("u", "v", "tu", "tv")
    return written(arrow_pass(both, partial(_linked_batch, rule=rule), "u long, v long", 4096).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v) whose component has a smaller node; root is the smallest.

    Each node hooks to its smallest smaller neighbour, paths are halved until they end, edges are renamed to roots and
    loops dropped, until no edge is left. Every step is joins and partial aggregates over written tables; nothing is
    collected, and rounds grow with the logarithm of the longest path.
    """
    pairs = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).filter("a <> b").distinct()
    labels = None
    while True:
        hooks = written(pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        if hooks.isEmpty():
            return labels if labels is not None else hooks
        while True:
            step = hooks.alias("x").join(hooks.select(F.col("node").alias("mid"), F.col("root").alias("far")), F.col("root") == F.col("mid"), "left")
            step = written(step.select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "hooks")
            forget(hooks)
            hooks, moved = step.select("node", "root"), not step.filter("moved").isEmpty()
            hooks._written_path = step._written_path
            if not moved:
                break
        if labels is None:
            labels = hooks
        else:
            renamed = labels.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = written(renamed.unionByName(hooks.join(labels.select("node"), "node", "left_anti")), "labels")
        old = pairs
        pairs = written(_rename(pairs, hooks, "a", "b").filter("a <> b").distinct(), "pairs")
        forget(old)


def _rename(pairs: DataFrame, hooks: DataFrame, *names: str) -> DataFrame:
    for c in names:
        pairs = pairs.join(hooks.select(F.col("node").alias(c), F.col("root").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return pairs.select(*[F.least(*names).alias(names[0]), F.greatest(*names).alias(names[1])])


def _possible(rule: Rule, n1: str, n2: str, max_bits: int | None, *bits: tuple[str, str]) -> Column:
    """Sizes allow the threshold, and the sketches do not rule it out (if they may)."""
    sizes = F.lit(100) * F.least(n1, n2) >= F.lit(rule.percent) * F.greatest(n1, n2)
    return sizes if max_bits is None else sizes & (_apart(*bits) <= max_bits)


def _apart(*bits: tuple[str, str]) -> Column:
    """Differing bits of two sketches."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in bits), F.lit(0))


def _stars(rest: DataFrame, traits: DataFrame, turn: int, rule: Rule, max_bits: int | None) -> DataFrame:
    """(x, u, v, apart): each class x of a mixed bucket with the bucket's leader, if that is of another component.

    apart orders a class's leaders: by differing bits of the sketches, then by how many buckets they share.

    The first leaders are the classes that meet most others, as an original does among its altered copies; later
    ones are drawn by hash.
    """
    order = F.struct("weight", F.negative("node").alias("k")) if not turn else F.struct(F.xxhash64("node", F.lit(turn)).alias("weight"), F.negative("node").alias("k"))
    leaders = rest.groupBy("bucket").agg(F.max(F.struct(order.alias("by"), F.col("root").alias("root"))).alias("best"))
    leaders = leaders.select("bucket", F.negative("best.by.k").alias("leader"), F.col("best.root").alias("lroot"))
    pairs = rest.select("bucket", "node", "root").join(leaders, "bucket").filter("root <> lroot").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("shared"))
    pairs = pairs.join(traits.select("node", "n", "b1", "b2"), "node").join(traits.select(F.col("node").alias("leader"), F.col("n").alias("ln"), F.col("b1").alias("lb1"), F.col("b2").alias("lb2")), "leader")
    bits = (("b1", "lb1"), ("b2", "lb2"))
    return pairs.filter(_possible(rule, "n", "ln", max_bits, *bits)).select(
        F.col("node").alias("x"), F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v"), F.struct(_apart(*bits).alias("bits"), F.negative("shared").alias("by")).alias("apart")
    )


def _merged(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """The roots after more links."""
    if roots is None:
        return components(found)
    more = components(_rename(found, roots, "u", "v"))
    renamed = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(renamed.unionByName(more.join(roots.select("node"), "node", "left_anti")), "roots")


class _Sets:
    """Components of one group's rows, by number."""

    def __init__(self, roots: np.ndarray) -> None:
        self.of = np.unique(roots, return_inverse=True)[1].ravel()

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]


def _group_links(rows: dict, rule: Rule, max_bits: int | None) -> list[tuple[int, int]]:
    """Links that join different components of one group: rows of block bi against rows of block bj, on full sets."""
    n, b1, b2, own = (np.asarray(rows[c], np.int64) for c in ("n", "b1", "b2", "own"))
    left, right = (np.flatnonzero(own == rows[c][0]) for c in ("bi", "bj"))
    sets = _Sets(np.asarray(rows["root"], np.int64))

    def partners(i: int) -> np.ndarray:
        small, large = np.minimum(n[right], n[i]), np.maximum(n[right], n[i])
        near = (sets.of[right] != sets.of[i]) & (100 * small >= rule.percent * large)
        if max_bits is not None:
            near &= sum(np.bitwise_count((b[right] ^ b[i]).view(np.uint64)).astype(np.int64) for b in (b1, b2)) <= max_bits
        return right[near]

    wanted = [len(partners(i)) > 0 for i in left]
    if not any(wanted):
        return []
    found = [shingles(t, rule.words) for part in rows["text"] for t in texts_as_bytes(part)]
    offsets = np.r_[0, np.cumsum([len(x) for x in found])]
    numbers = np.unique(np.concatenate(found), return_inverse=True)[1].ravel()
    flags, out = np.zeros(len(numbers) + 1, np.int64), []
    for i in left[np.array(wanted)]:
        near = partners(i)
        if not len(near):
            continue
        mine = numbers[offsets[i] : offsets[i + 1]]
        flags[mine] = 1
        for j in near:
            if sets.of[i] != sets.of[j]:
                both = int(flags[numbers[offsets[j] : offsets[j + 1]]].sum())
                if 100 * both >= rule.percent * (len(found[i]) + len(found[j]) - both):
                    out.append((rows["node"][i], rows["node"][j]))
                    sets.join(i, j)
        flags[mine] = 0
    return out


def _sorted_groups(batches, rule: Rule, max_bits: int | None):
    """Links of each group of rows sorted by (bucket, bi, bj); a group may run over several batches."""
    at, held = None, None
    names = ["node", "root", "n", "b1", "b2", "own", "bi", "bj", "text"]

    def made() -> pa.RecordBatch:
        links = _group_links(held, rule, max_bits)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("bucket", *names)}
        keys = list(zip(*(column[c].to_pylist() for c in ("bucket", "bi", "bj"))))
        start = 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[start]:
                if keys[start] != at:
                    if held:
                        yield made()
                    at, held = keys[start], {c: [] for c in names}
                for c in names:
                    part = column[c].slice(start, end - start)
                    held[c].append(part) if c == "text" else held[c].extend(part.to_pylist())
                start = end
    if held:
        yield made()


def _with_partners(rows: DataFrame, rule: Rule, max_bits: int | None) -> DataFrame:
    """The rows of buckets that have a possible partner of another component in the same bucket, each once.

    Large buckets are cut into blocks first and a row is compared within pairs of blocks, so a task compares no more
    than PARTNER_ROWS rows with as many, whatever a bucket holds. Sizes and sketches alone travel. Of two rows, the
    shorter one must be in the bucket by one of its first shingles (`first`).
    """
    cols = ("node", "root", "n", "b1", "b2", "first", "size")
    blocks = F.ceil(F.col("size") / PARTNER_ROWS)
    dealt = rows.select("bucket", *cols, F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", *cols)
    x, y = (dealt.select(*[F.col(c).alias(f"{c}{i}") for c in ("bucket", "bi", "bj", "own", *cols)]) for i in "xy")
    same = (F.col("bucketx") == F.col("buckety")) & (F.col("bix") == F.col("biy")) & (F.col("bjx") == F.col("bjy"))
    # in a pair of different blocks, rows meet those of the other one alone
    across = (F.col("bix") == F.col("bjx")) | (F.col("ownx") != F.col("owny"))
    looked_up = (F.col("firstx") & (F.col("nx") <= F.col("ny"))) | (F.col("firsty") & (F.col("ny") <= F.col("nx")))
    possible = same & across & (F.col("rootx") != F.col("rooty")) & looked_up & _possible(rule, "nx", "ny", max_bits, ("b1x", "b1y"), ("b2x", "b2y"))
    found = x.join(y, possible, "left_semi").select(*[F.col(f"{c}x").alias(c) for c in ("bucket", *cols)])
    return found.distinct()


def _shingle_batch(batch: pa.RecordBatch, rule: Rule) -> pa.RecordBatch:
    sets = [_signed(shingles(t, rule.words)) for t in texts_as_bytes(batch.column(1))]
    offsets = np.r_[0, np.cumsum([len(x) for x in sets])]
    values = np.concatenate(sets) if sets else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], ["node", "shingles"])


def _rare_buckets(rest: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(bucket, node, root, n, b1, b2, first, size), written: classes of mixed buckets, met anew by their rarest shingles.

    A set's order is by how many of these classes hold a shingle, then by hash. Those that no other class holds come
    first and are only counted. first: the shingle counts by the shorter set's measure.
    """
    left = written(rest.select("node", "root", "n", "b1", "b2").distinct(), "left")
    sets = texts.withColumnRenamed("id", "node").join(left.select("node"), "node", "left_semi").select("node", "text")
    sets = written(arrow_pass(sets, partial(_shingle_batch, rule=rule), "node long, shingles array<long>"), "left-sets")
    each = sets.select("node", F.explode("shingles").alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    held = each.join(counts, "bucket").join(left.select("node", "n"), "node")
    of = Window.partitionBy("node")
    place = F.col("n") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("size", "bucket"))
    rare = held.withColumn("place", place).filter(F.col("place") <= rule.probe(F.col("n"))).select("bucket", "node", (F.col("place") <= rule.index(F.col("n"))).alias("first"))
    met = written(rare.join(left, "node"), "rarest")
    mixed = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("first").alias("any")).filter("any AND r0 < r1")
    out = written(met.join(mixed.select("bucket", "size"), "bucket"), "rarest-met")
    for table in (left, sets, met):
        forget(table)
    return out


def _needed_buckets(possible: DataFrame) -> DataFrame:
    """(bucket): buckets whose pairs are not all in another bucket anyway, as classes share several rare shingles.

    Of buckets with equal members one stays; and where all members of a bucket have the same other one as their
    largest, they meet there.
    """
    named = possible.select("bucket", "node").distinct()
    members = written(named.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), *_members("node")), "bucket-members")
    one = members.groupBy("k", "m1", "m2").agg(F.min("bucket").alias("bucket")).select("bucket", "k")
    named = written(named.join(one, "bucket"), "bucket-members")
    largest = named.groupBy("node").agg(F.max(F.struct("k", "bucket")).alias("_l")).select("node", F.col("_l.bucket").alias("largest"))
    picks = named.join(largest, "node").groupBy("bucket").agg(F.min("largest").alias("l0"), F.max("largest").alias("l1"))
    return picks.filter("l0 <> l1 OR l0 = bucket").select("bucket")


def _regrouped(possible: DataFrame) -> DataFrame:
    """possible (bucket, node, root, n, b1, b2) with one bucket for each small family, of classes that buckets join.

    All pairs of a family of FAMILY_ROWS classes at most are in its one bucket, so its texts travel once; of larger
    families the buckets stay that are needed. No pair that shares a bucket is lost.
    """
    cols = ["node", "root", "n", "b1", "b2"]
    named = possible.select("bucket", "node").distinct()
    leads = named.groupBy("bucket").agg(F.min("node").alias("u"))
    above = components(named.join(leads, "bucket").select("u", F.col("node").alias("v"))).select("node", F.col("root").alias("family"))
    rows = written(possible.select(*cols).distinct().join(above, "node", "left").withColumn("family", F.coalesce("family", "node")), "families")
    small = rows.groupBy("family").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m")).filter((F.col("k") <= FAMILY_ROWS) & (F.col("m") <= BLOCK_SHINGLES)).select("family")
    whole = rows.join(small, "family", "left_semi").select(F.col("family").alias("bucket"), *cols)
    large = written(possible.select("bucket", *cols).join(rows.join(small, "family", "left_anti").select("node"), "node", "left_semi"), "possible")
    return whole.unionByName(large.join(_needed_buckets(large), "bucket", "left_semi").select("bucket", *cols))


def _links_left(rest: DataFrame, texts: DataFrame, rule: Rule, max_bits: int | None) -> DataFrame:
    """Links between classes of different components that are left in mixed buckets, written.

    A large bucket is cut into blocks, and each pair of blocks is a group of its own, of bounded rows and shingles;
    failing pairs never leave the group, and links leave it only while they join components.
    """
    rare = _rare_buckets(rest, texts, rule)
    possible = written(_with_partners(rare, rule, max_bits), "possible")
    forget(rare)
    some = written(_regrouped(possible), "possible")
    forget(possible)
    blocks = some.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    dealt = some.join(blocks, "bucket").select("*", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "node", "root", "n", "b1", "b2")
    grouped = dealt.join(texts.withColumnRenamed("id", "node"), "node").repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    ship_package(grouped.sparkSession)
    out = written(grouped.mapInArrow(partial(_sorted_groups, rule=rule, max_bits=max_bits), "u long, v long").distinct(), "links-left")
    forget(some)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int | None = MAX_BITS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of df.

    Rows that repeat an id count as one document. Empty and null texts have no shingles and are their own component.
    A row without an id belongs to the component of its text's class, and has none (null) if no row of the class has
    an id. Other columns of df are not read. An empty table gives an empty table. With max_bits None no pair of a
    bucket is turned down by its sketches; sizes alone spare comparisons then, which is exact.
    """
    return linked_components(df, signatures(df, id_col, text_col), Rule(), id_col, text_col, max_bits)


def _members(*of: str) -> list[Column]:
    """128 bits that tell a bucket's set of classes, each there once, from another one of its size."""
    return [F.bit_xor(F.xxhash64(*of)).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), *of)).alias("m2")]


def linked_components(df: DataFrame, sig: DataFrame, rule: Rule, id_col: str, text_col: str, max_bits: int | None) -> DataFrame:
    """(id, n_shingles, component_id, kept) from signatures of df's rows (id, n, h1, h2, b1, b2, bands).

    Rows meet where they share a value of bands; with max_bits None, b1 and b2 decide nothing.
    """
    sig = written(sig, "signatures")
    reps = written(
        sig.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in ("n", "b1", "b2", "bands")]).filter("node IS NOT NULL"), "classes"
    )
    banded = reps.select("node", "h1", "h2", F.explode("bands").alias("bucket"))  # rows of one id may be several classes
    # of buckets with equal members, which near copies have many of, one stays
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *_members("node", "h1", "h2")).filter("size > 1")
    met = written(banded.select("bucket", "node").join(shared.groupBy("size", "m1", "m2").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "bucket"), "buckets")
    weights = met.groupBy("node").agg(F.sum("size").alias("weight"))
    traits = written(reps.select("node", "n", "b1", "b2").join(weights, "node"), "traits")
    pool = written(met.select("bucket", "node").join(traits, "node").withColumn("root", F.col("node")), "candidates")
    forget(met)
    # candidates are too many to broadcast where it matters, so the join is a shuffle at every size
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(traits.select(F.col("node").alias("id")).hint("merge"), "id", "left_semi")
    texts = written(texts.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["id", "_hash"]).drop("_hash"), "candidate-texts")

    # turns of comparing with leaders: each links some components or is the last one
    roots, tried = None, None
    rest = _mixed(pool, roots)
    for turn in range(TURNS):
        stars = _stars(rest, traits, turn, rule, max_bits)
        if tried is not None:
            stars = stars.join(tried, ["u", "v"], "left_anti")
        nearest = written(stars.groupBy("x").agg(F.min(F.struct("apart", "u", "v")).alias("best")).select("best.u", "best.v").distinct(), "tried")
        if nearest.isEmpty():
            break
        found = linked(nearest, texts, rule)
        if found.isEmpty():
            break
        roots = _merged(roots, found)
        tried = nearest if tried is None else tried.unionByName(nearest)
        forget(rest)
        rest = _mixed(pool, roots)

    # what is left: classes of different components that share a bucket
    roots = _merged(roots, _links_left(rest, texts, rule, max_bits))
    for table in (rest, pool, traits, texts):
        forget(table)

    rooted = reps.select("h1", "h2", "node").join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
    out = sig.select("id", "n", "h1", "h2").join(rooted, ["h1", "h2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("root"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _mixed(pool: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold classes of several components, with the components' roots, written."""
    placed = pool if roots is None else pool.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("bucket")
    return written(placed.join(mixed, "bucket"), "mixed-buckets")


def op3_neardup(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).withColumnRenamed("id", "doc_id")


def op3_sql() -> str:
    """All pairs that share a shingle, in DuckDB; components by a recursive query."""
    return r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    meet AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM meet JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
    two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, two.b FROM reach JOIN two ON two.a = reach.r),
    least_one AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least_one l ON l.doc_id = d.doc_id
    """
