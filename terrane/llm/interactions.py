"""How filters interact: what each order of several filters keeps, removes and finds already gone.

A document's outcome under any order depends on its failure mask alone. So the corpus shrinks to an incidence matrix:
one row of counts over the 2 ** k masks for each part, and one for each label. Those rows, times fixed integer
matrices of 2 ** k rows and one column for each step of each order (32 by 600 for five filters), are the counts kept,
removed, redundant and unique at every step. Counts are 64-bit integers throughout, so nothing is rounded.

Texts are read once, in tasks, for a mask and a digest. The counts are sums by part and mask, combined before the
shuffle, so a part of any size costs a few rows a task; the products are made a batch of parts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import partial
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import arrow_pass, texts_as_bytes, written

#: The filters' letters, in the order of their bits.
LETTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(65, 91))
#: Bytes of UTF-8 that begin no code point.
_FOLLOWING = bytes(range(0x80, 0xC0))
#: More than this would make a matrix of more than 5040 * 7 columns.
MOST_FILTERS = 7
#: Parts that are multiplied at once: a batch's result has 120 * 5 rows for each part.
PARTS = 64


def orders(letters: str) -> list[str]:
    """Every order of the filters, in alphabetical order."""
    return ["".join(p) for p in permutations(sorted(letters))]


def outcome_matrices(letters: str = LETTERS) -> dict[str, np.ndarray]:
    """Of each outcome, a matrix with a row for each failure mask and a column for each (order, step).

    kept: no filter up to the step fails. removed: the step's filter is the first that fails. redundant: it fails, but
    an earlier one did. unique: it fails and no other does. shapley: the columns of removed, summed over all orders at
    the step, wherever it is, of the same filter.
    """
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) != len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} different filters are needed")
    k = len(letters)
    bit = {c: 1 << i for i, c in enumerate(letters)}
    masks = np.arange(1 << k)
    filters = [bit[c] for order in orders(letters) for c in order]
    before = [sum(bit[c] for c in order[:step]) for order in orders(letters) for step in range(k)]
    this, earlier = np.array(filters), np.array(before)
    fails = (masks[:, None] & this[None, :]) > 0
    gone = (masks[:, None] & earlier[None, :]) > 0
    out = {"kept": ~gone & ~fails, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks[:, None] == this[None, :]}
    out = {name: m.astype(np.int64) for name, m in out.items()}
    out["shapley"] = out["removed"] @ (this[:, None] == this[None, :]).astype(np.int64)
    return out


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    masks, digests = [], []
    for text in texts_as_bytes(batch.column(2)):
        text = text or b""
        words = text.split()  # of bytes: at the six ASCII blanks
        points = len(text.translate(None, _FOLLOWING))
        upper = len(text) - len(text.translate(None, _UPPER))
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        fails = (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words), 100 * upper > MAX_UPPER_PERCENT * points, symbols > 0)
        masks.append(sum(1 << i for i, f in enumerate(fails) if f))
        digests.append(hashlib.blake2b(text, digest_size=16).digest())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])


def failure_masks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) of every document: bit 0 to 4 for the filters A to E.

    A: under 50 words. B: 100 * distinct words < 65 * words. C: 100 * letters A-Z > 5 * code points. D: one of
    `#$%&*|`. E: the text is that of a document with a smaller id, wherever that is. Null texts count as empty and
    null parts as the empty string. A document without an id is never a copy and none is a copy of it; rows that repeat
    an id and a text are copies only of smaller ids. An empty table gives an empty table. Other columns are not read.
    """
    plain = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    rows = written(arrow_pass(plain, _features, "id long, part string, mask int, digest binary"), "features")  # read twice
    # one row for each text: a group of copies of any size is combined before the shuffle
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).filter("id IS NOT NULL").withColumn("first", F.lit(True))
    rows = rows.join(first, ["id", "digest"], "left")  # ids spread the copies of one text
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.select("id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).cast("int").alias("mask"))


def mask_histograms(masks: DataFrame, weights: dict[str, Column], bits: int) -> DataFrame:
    """(part, n, and each weight's name): arrays of 2 ** bits counts, of the rows and of those where the weight holds."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(F.when(w, 1).otherwise(0)).alias(name) for name, w in weights.items()]]
    cells = masks.groupBy("part", "mask").agg(*sums)
    # at most 2 ** bits rows of a part meet
    held = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", *weights)))).alias("of"))
    every = F.sequence(F.lit(0), F.lit((1 << bits) - 1))

    def counts(name: str) -> Column:
        return F.transform(every, lambda m: F.coalesce(F.try_element_at("of", m).getField(name), F.lit(0))).alias(name)

    return held.select("part", *[counts(c) for c in ("n", *weights)])


def _outcomes(batch: pa.RecordBatch, letters: str, labels: Sequence[str]) -> pa.RecordBatch | None:
    if not batch.num_rows:
        return None
    made, size = outcome_matrices(letters), 1 << len(letters)
    rows = {c: np.array(batch.column(c).to_pylist(), np.int64).reshape(-1, size) for c in ("n", *labels)}
    steps, named = len(letters), orders(letters)
    count = len(named) * steps
    columns = {
        "part": batch.column("part").take(pa.array(np.repeat(np.arange(batch.num_rows), count))),
        "filter_order": pa.array([o for o in named for _ in range(steps)] * batch.num_rows),
        "step": pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), batch.num_rows * len(named))),
    }
    columns |= {name: pa.array((rows["n"] @ made[name]).ravel()) for name in ("kept", "removed", "redundant", "unique_fails")}
    columns |= {f"{c}_lost": pa.array((rows[c] @ made["removed"]).ravel()) for c in labels}
    columns["shapley"] = pa.array((rows["n"] @ made["shapley"]).ravel())
    return pa.RecordBatch.from_pydict(columns)


def audit(masks: DataFrame, letters: str = LETTERS, weights: dict[str, Column] | None = None) -> DataFrame:
    """A row for each part, order of the filters (`filter_order`) and step, from rows (part, mask, and what weights read).

    kept, removed, redundant and unique_fails count the part's rows at the step; `<name>_lost` counts the removed rows
    where that weight is true (null: not). shapley is the step's filter's removed, summed over all orders: divided by
    their number, the filter's Shapley value. Masks hold bit i for the failing of letter i; a row with a null mask or
    one of other bits is an error. No rows give no rows.
    """
    weights = weights or {}
    bits = len(letters)
    good = F.col("mask").between(0, (1 << bits) - 1)
    checked = masks.withColumn("mask", F.when(good, F.col("mask")).otherwise(F.raise_error(F.lit("mask out of range"))))
    tables = mask_histograms(checked, weights, bits)
    longs = ["kept", "removed", "redundant", "unique_fails", *[f"{c}_lost" for c in weights], "shapley"]
    fn: Callable = partial(_outcomes, letters=letters, labels=tuple(weights))
    return arrow_pass(tables, fn, "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in longs), PARTS)


def op11_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters, by source, with what each step loses of good (quality 1) and toxic documents.

    A document is good or toxic if any label of its id says so; labels without an id count for none.
    """
    masks = failure_masks(documents)
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return audit(masks.join(told, "id", "left"), weights={"good": F.col("good"), "toxic": F.col("toxic")})


def op11_sql() -> str:
    """The same counts from each document's flags, in DuckDB."""
    steps = """SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
      FROM f a JOIN f b ON b.l <> a.l JOIN f c ON c.l NOT IN (a.l, b.l) JOIN f d ON d.l NOT IN (a.l, b.l, c.l) JOIN f e ON e.l NOT IN (a.l, b.l, c.l, d.l)"""
    return rf"""
    WITH texts AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    told AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    flags AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
      FROM texts LEFT JOIN told USING (doc_id)),
    counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    o AS ({steps}),
    places AS (SELECT filter_order, s AS step, substr(filter_order, s::INT, 1) AS l, substr(filter_order, 1, s::INT - 1) AS earlier FROM o, range(1, 6) r(s)),
    told_steps AS (
      SELECT part, filter_order, step, l, n, good, toxic, fails, contains(fails, l) AS bad,
        len(list_intersect(string_split(earlier, ''), string_split(fails, ''))) > 0 AND earlier <> '' AND fails <> '' AS gone
      FROM counts, places),
    sums AS (
      SELECT part, filter_order, step, l, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = l THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS toxic_lost
      FROM told_steps GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
      good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM sums
    """
