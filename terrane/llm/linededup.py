"""Line dedup: drop lines that many documents share, except in one document.

Lines are exploded and normalised, hashed to two 64-bit values, and counted by distinct documents; frequent hashes
lose their lines except in the largest doc_id that holds them; each text is then put together again from its remaining
lines by position. Only hashes and ids are shuffled, and the text once, to meet its dropped hashes.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import ascii_lower, forget, strip_blanks, written

MIN_CHARS = 20
MIN_DOCS = 3
SALTS = 32


def line_key(line: Column) -> Column:
    """What makes lines equal: no blanks at either end, A-Z lower-cased."""
    return ascii_lower(strip_blanks(line))


def _hashes(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: together they tell 10 ** 15 keys apart."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def frequent_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, n_docs, owner) of frequent lines, and the (h1, h2, salt, id, text_hash) that hold a line found often.

    Lines are taken apart and hashed once; a first count by hash leaves out what occurs seldom, before distinct
    documents are counted: most lines are unique. Partial sums and salts keep a line of every third document from
    meeting in one task.
    """
    line = F.explode(F.split(F.col(text_col), "\n")).alias("line")
    key = line_key(F.col("line"))
    exploded = df.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("text_hash"), line).filter(F.char_length("line") >= min_chars)
    h1, h2 = _hashes(F.col("key"))
    lines = exploded.select("id", "text_hash", key.alias("key")).filter(F.char_length("key") >= min_chars).select("id", "text_hash", h1.alias("h1"), h2.alias("h2"))
    lines = written(lines.withColumn("salt", _salt(F.xxhash64("id", "text_hash"))), "line-hashes")
    often = lines.groupBy("h1", "h2").agg(F.count("id").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2", _every_salt())
    held = written(lines.join(often, ["h1", "h2", "salt"], "left_semi").distinct(), "line-holders")
    forget(lines)
    # rows of one id may differ in their texts, so a document is counted once by its id
    once = held.filter("id IS NOT NULL").select("h1", "h2", "id").distinct()
    frequent = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("owner")).filter(F.col("n_docs") >= min_docs)
    return frequent, held


def _text_hash(text_col: str) -> Column:
    """Tells rows of one id, and rows without an id, apart by their texts."""
    return F.xxhash64(F.col(text_col), F.lit("text"))


def _salt(by: Column) -> Column:
    return F.pmod(by, F.lit(SALTS)).cast("int")


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """df with text_col replaced by what is left of it, and n_lines and n_dropped (long) added.

    A null or empty text is one empty line and comes back as an empty text. Rows that repeat an id count as one
    document and lose the same lines. Rows without an id count as no document but lose frequent lines; each is taken
    by its own text, so they never meet in one row. An empty table gives an empty table. Columns of df named n_lines
    or n_dropped are replaced.
    """
    frequent, held = frequent_lines(df, id_col, text_col, min_chars, min_docs)
    # a line that very many documents hold is dealt to SALTS tasks
    drops = (
        held.join(frequent.select("h1", "h2", "owner", _every_salt()), ["h1", "h2", "salt"]).filter(~F.col("id").eqNullSafe(F.col("owner")))
        .groupBy("id", "text_hash").agg(F.collect_set(F.struct("h1", "h2")).alias("_drops"))
    )
    # many rows may be without an id and equal in text: those are dealt to SALTS tasks too
    spread = F.when(F.col("id").isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    drops = drops.select(F.col("id").alias("_drop_id"), F.col("text_hash").alias("_drop_hash"), "_drops", F.explode(spread).alias("_drop_salt"))
    # df's own columns travel as one struct, so no name of theirs can clash
    rows = df.select(
        F.struct("*").alias("_row"), F.col(id_col).alias("_id"), _text_hash(text_col).alias("_hash"),
        F.when(F.col(id_col).isNull(), _salt(F.monotonically_increasing_id())).otherwise(0).alias("_salt"),
    )
    rows = rows.join(drops, F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_hash") == F.col("_drop_hash")) & (F.col("_salt") == F.col("_drop_salt")), "left")
    whole = F.coalesce(F.col("_row")[text_col], F.lit(""))
    lines = F.split(whole, "\n")

    def stays(line: Column) -> Column:
        key = line_key(line)
        h1, h2 = _hashes(key)
        return (F.char_length(key) < min_chars) | ~F.array_contains(F.col("_drops"), F.struct(h1.alias("h1"), h2.alias("h2")))

    # positions are those of the array; a text without drops is not taken apart
    rows = rows.withColumn("_left", F.when(F.col("_drops").isNotNull(), F.filter(lines, stays)))
    text = F.when(F.col("_left").isNull(), whole).otherwise(F.array_join("_left", "\n"))
    return rows.select(
        *[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns if c.lower() not in ("n_lines", "n_dropped")],
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("_left").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_left")).cast("long").alias("n_dropped"),
    )


def op4_lines(documents: DataFrame) -> DataFrame:
    """The contract's columns: lines before, lines dropped, and the digest of the text that is left."""
    return dedup_lines(documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op4_sql() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT id, doc_id, i, lines[i] AS line FROM (SELECT id, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
    k AS (SELECT *, translate(trim(line, {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
    m AS (SELECT k.*, f.owner IS NOT NULL AND f.owner IS DISTINCT FROM k.doc_id AS gone FROM k LEFT JOIN f USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY id
    """
