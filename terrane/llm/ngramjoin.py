"""N-gram Jaccard join by PartEnum signatures.

Sizes are cut into bands [l, r] with r at most l / t, so sets that reach the threshold t are in the same band or in
neighbouring ones. For each band, sets of up to r shingles that reach t differ in at most k = 2 r (1 - t) / (1 + t)
of them. The domain of shingles is cut into (k + 1) / (K + 1) parts, each into SUBPARTS smaller ones: in some part two
such sets differ in no more than K shingles, so they agree on all but K of its smaller parts. A set's signatures are,
for each part, the hashes of what it has in each choice of SUBPARTS - K smaller parts. A set has those of its own band
and of the next one, and sets that reach the threshold share one for certain: nothing is missed.

Sets that share a signature are compared as in near-duplicate detection: with leaders first, what is left by rarest
shingles, always on full sets. Equal sets are one class from the start and never paired.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import arrow_pass, texts_as_bytes
from terrane.llm.neardup import Rule, _mix, _signed, linked_components, shingles

RULE = Rule(words=3, percent=90)
#: Smaller parts of each part, and how many of them a signature may leave out.
SUBPARTS, LEFT_OUT = 2, 1
_CHOICES = list(combinations(range(SUBPARTS), SUBPARTS - LEFT_OUT))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=65536)
def band_of(n: int, percent: int) -> tuple[int, int, int]:
    """(number, greatest size, greatest size of the next) of the band of size n; band 0 holds size 1."""
    number, low = 0, 1
    while True:
        high = low * 100 // percent
        if n <= high:
            return number, high, (high + 1) * 100 // percent
        number, low = number + 1, high + 1


def differing(size: int, percent: int) -> int:
    """How many shingles two sets of at most this size differ in at most, if they reach the threshold."""
    return 2 * size * (100 - percent) // (100 + percent)


def parts_of(k: int) -> int:
    """Parts of the domain so that some part has no more than LEFT_OUT of k differences."""
    return -(-(k + 1) // (LEFT_OUT + 1))


def signatures_of(x: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set of hashes: SUBPARTS over LEFT_OUT for each part, for its own band and the next one."""
    if not len(x):
        return np.empty(0, np.uint64)
    number, high, higher = band_of(len(x), percent)
    spread = _mix(x * _PRIME + np.uint64(7))
    value = _mix(x + _PRIME)
    out = []
    for band, size in ((number, high), (number + 1, higher)):
        k = differing(size, percent)
        if k == 0:
            continue  # equal sets alone reach the threshold here, and these are one class
        parts = parts_of(k)
        # exclusive-or of the hashes that fall into each smaller part stands for what the set has there
        cell = ((spread >> np.uint64(32)) % np.uint64(parts * SUBPARTS)).astype(np.int64)
        held = np.zeros(parts * SUBPARTS, np.uint64)
        np.bitwise_xor.at(held, cell, value)
        held = held.reshape(parts, SUBPARTS)
        seed = np.arange(parts, dtype=np.uint64) * _PRIME + np.uint64(band << 8)
        for i, choice in enumerate(_CHOICES):
            h = _mix(seed + np.uint64(i))
            for c in choice:
                h = _mix(h * _PRIME + held[:, c])
            out.append(h)
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _batch(batch: pa.RecordBatch, rule: Rule) -> pa.RecordBatch:
    sets = [shingles(t, rule.words) for t in texts_as_bytes(batch.column(1))]
    digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) for x in sets], np.int64).reshape(-1, 2)
    found = [signatures_of(x, rule.percent) for x in sets]
    offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32())
    values = _signed(np.concatenate(found)) if found else np.empty(0, np.int64)
    nil = pa.array(np.zeros(len(sets), np.int64))
    sizes = pa.array(np.array([len(x) for x in sets], np.int64))
    columns = [batch.column(0), sizes, *(pa.array(np.ascontiguousarray(digest[:, j])) for j in (0, 1)), nil, nil, pa.ListArray.from_arrays(offsets, pa.array(values))]
    return pa.RecordBatch.from_arrays(columns, ["id", "n", "h1", "h2", "b1", "b2", "bands"])


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of df: classes of rows that links join.

    Rows that repeat an id count as one document. Empty and null texts have no shingles and link with nothing. A row
    without an id belongs to the component of the rows with its set, and has none (null) if none of them has an id.
    Other columns are not read. An empty table gives an empty table. No link is missed, but where 64-bit hashes of
    different shingles agree.
    """
    plain = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = arrow_pass(plain, partial(_batch, rule=rule), "id long, n long, h1 long, h2 long, b1 long, b2 long, bands array<long>")
    return linked_components(df, sig, rule, id_col, text_col, None)


def op13_join(documents: DataFrame) -> DataFrame:
    return ngram_join(documents).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op13_sql() -> str:
    """All pairs that share a shingle, in DuckDB; components by a recursive query."""
    return r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    meet AS (
      SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
      FROM (SELECT * FROM s JOIN n USING (doc_id)) x JOIN (SELECT * FROM s JOIN n USING (doc_id)) y
      ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY ALL),
    e AS (SELECT a, b FROM meet JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
    two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, two.b FROM reach JOIN two ON two.a = reach.r),
    least_one AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least_one l ON l.doc_id = d.doc_id
    """
