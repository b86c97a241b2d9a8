"""Benchmark decontamination by winnowing.

Of every WINDOW - GRAM + 1 consecutive word k-grams the least hash is a fingerprint, so any span of WINDOW words that a
document shares with an item gives both the same fingerprint. Fingerprints of documents and items are joined by
equality; documents that share one are then compared by whole windows, which extends each hit to the full shared
span. Items of fewer than WINDOW words are one window of their own length, looked up by their own hash in the same pass.
Equal windows of items are one class with one list of items, so a passage that many items share is joined once.
DataFrame functions only. Spark broadcasts the item side only where its written size is below its own threshold.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import WORD_GAP, ascii_lower, bound, written

WINDOW = 13
GRAM = 8
#: A document is contaminated if hit words are at least one in SHARE of its words.
SHARE = 20
#: Fixed pattern: what separates words in a text that is not lower-cased yet.
ANY_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def _gram(hashes: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(length)])


def _starts(n: Column, length: int) -> Column:
    """0 .. n - length; empty where there are fewer words."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _hashes(found: Column, second: bool = False) -> Column:
    return F.transform(found, lambda w: F.xxhash64(F.lit("second"), w) if second else F.xxhash64(w))


def _winnowed(hashes: Column) -> Column:
    """Distinct least hashes of every run of WINDOW - GRAM + 1 grams."""
    width = WINDOW - GRAM + 1
    grams = F.transform(_starts(F.size(hashes), GRAM), lambda i: _gram(hashes, i, GRAM))
    return bound(grams, lambda g: F.array_distinct(F.transform(_starts(F.size(g), width), lambda i: F.least(*[F.get(g, i + j) for j in range(width)]))))


def _short(hashes: Column, lengths: list[int]) -> Column:
    """Hashes of all runs of these lengths; the length is hashed too."""
    runs = [F.transform(_starts(F.size(hashes), n), partial(_run, hashes, n)) for n in lengths]
    return F.concat(*runs) if runs else F.array().cast("array<bigint>")


def _run(hashes: Column, length: int, at: Column) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(hashes, at + j) for j in range(length)])


def fingerprints(df: DataFrame, keep: list[str], text: Column, short: list[int]) -> DataFrame:
    """keep, then prints: the distinct winnowed fingerprints of texts (none of a text of fewer than WINDOW words), and
    the hashes of all runs of the short lengths, in one pass over a text whatever their number."""
    prints = lambda h: F.array_distinct(F.concat(_winnowed(h), _short(h, short)))
    return df.select(*keep, bound(_hashes(words(text)), prints).alias("prints"))


def _windows(hashed: DataFrame, keep: list, lengths: list[int]) -> DataFrame:
    """keep, length, at, w1, w2: every window of so many words, by two independent hashes; one pass for all lengths."""

    def each(h1: Column, h2: Column, length: int) -> Column:
        second = lambda i: F.xxhash64(F.lit(length), *[F.get(h2, i + j) for j in range(length)])
        return F.transform(_starts(F.size(h1), length), lambda i: F.struct(F.lit(length).alias("length"), i.alias("at"), _gram(h1, i, length).alias("w1"), second(i).alias("w2")))

    every = lambda s: F.concat(*[each(s["h1"], s["h2"], n) for n in lengths])
    both = bound(F.struct(F.col("_h1").alias("h1"), F.col("_h2").alias("h2")), every)
    return hashed.select(*keep, F.explode(both).alias("_w")).select("*", "_w.length", "_w.at", "_w.w1", "_w.w2").drop("_w")


def _hashed(df: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """keep, _h1, _h2: two hashes of each word."""
    both = bound(words(text), lambda w: F.struct(_hashes(w).alias("h1"), _hashes(w, second=True).alias("h2")))
    return df.select(*keep, both.alias("_h")).select(*keep, F.col("_h.h1").alias("_h1"), F.col("_h.h2").alias("_h2"))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated), for the texts with a hit word alone.

    Rows equal in id and text share one row of the result. Null texts and null items have no words. An item without
    an id marks words but is not listed. Equal items are all listed.
    """
    named = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    items = written(_hashed(named, ["item"], F.col("text")).filter(F.size("_h1") > 0), "benchmark-words")
    short = sorted(r[0] for r in items.filter(F.size("_h1") < WINDOW).select(F.size("_h1")).distinct().collect())  # fewer than WINDOW values
    lengths = [*short, WINDOW]
    # an item's windows all have one length: WINDOW, or that of the whole item
    windows = _windows(items, ["item", F.least(F.size("_h1"), F.lit(WINDOW)).alias("own")], lengths).filter("length = own").select("item", "length", "w1", "w2").distinct()
    # equal windows are one; those found in the same items, which a hash without an order tells, share one list of them
    windows, window = written(windows, "benchmark-windows"), ["length", "w1", "w2"]
    items_of = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("item")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("m2")]
    classes = windows.groupBy(*window).agg(*items_of).select(*window, F.xxhash64("n", "m1", "m2").alias("list"))
    classes = written(classes, "benchmark-classes")
    prints = written(_item_prints(named, short), "benchmark-prints")
    # the items of a list are those of one of its windows
    first = classes.groupBy("list").agg(F.min(F.struct(*window)).alias("w")).select("list", "w.*")
    lists = written(windows.join(first, window).select("list", "item").filter("item IS NOT NULL"), "benchmark-lists")

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    key = ["id", "text_hash"]
    hit = fingerprints(rows, key, F.col("text"), short).select(*key, F.explode("prints").alias("print")).join(prints, "print", "left_semi").select(*key)
    hit = written(hit.distinct().withColumnsRenamed({"id": "_id", "text_hash": "_hash"}), "print-hits")

    # extend: every window of the documents that share a fingerprint
    near = rows.join(hit, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi").dropDuplicates(key)
    hashed = written(_hashed(near, key, F.col("text")), "hit-words")
    spans = _windows(hashed, key, lengths)
    spans = written(spans.join(classes, ["length", "w1", "w2"]).select(*key, "at", (F.col("at") + F.col("length")).alias("end"), "list"), "hit-spans")
    # of the windows at one start the longest counts; a text has no more starts than words
    ends = spans.groupBy(*key, "at").agg(F.max("end").alias("end"))
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "end"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["at"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto")),
        lambda acc: acc["n"].cast("long"),
    )
    counted = ends.groupBy(*key).agg(covered.alias("n_hit"))
    # texts that hit the same lists share one result: a passage of many items in many documents is listed once
    listed = written(spans.select(*key, "list").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("list")).alias("lists")), "hit-lists")
    merged = listed.select("lists").distinct().withColumn("list", F.explode("lists")).join(lists, "list").select("lists", "item").distinct()
    merged = merged.groupBy("lists").agg(F.array_sort(F.collect_list("item")).alias("found"))
    merged = merged.select("lists", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"))
    merged = listed.join(merged, "lists", "left").select(*key, F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    out = hashed.select(*key, F.size("_h1").cast("long").alias("n_words"))
    for more in (counted, merged):
        renamed = more.withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
        out = out.join(renamed, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).drop("_id", "_hash")
    return out.select(
        *key, "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _item_prints(named: DataFrame, short: list[int]) -> DataFrame:
    """Distinct fingerprints of items: winnowed ones of items of WINDOW words and more, the whole of shorter ones."""

    def prints(h: Column) -> Column:
        whole = F.lit(None).cast("bigint")
        for n in short:
            whole = F.when(F.size(h) == n, _run(h, n, F.lit(0))).otherwise(whole)
        return F.array_compact(F.concat(_winnowed(h), F.array(whole)))

    return named.select(F.explode(bound(_hashes(words(F.col("text"))), prints)).alias("print")).distinct()


def op9_decontam(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns for all documents; those without a hit have an empty list of items."""
    found = written(contamination(documents, benchmark), "contamination").drop("n_words").withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), ANY_GAP), "")).cast("long").alias("n_words"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def clean_documents(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without its contaminated rows."""
    bad = written(contamination(df, benchmark, id_col, text_col).filter("contaminated").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")), "contaminated")
    return df.join(bad, df[id_col].eqNullSafe(bad["_id"]) & (F.xxhash64(df[text_col]) == bad["_hash"]), "left_anti")


def op9_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
    bw AS (
      SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    lens AS (SELECT DISTINCT k FROM bw),
    dw AS (
      SELECT id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
      FROM (SELECT id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
    hit AS (SELECT id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
    cov AS (SELECT id, count(DISTINCT i + j) AS n_hit FROM hit, range({WINDOW}) t(j) WHERE j < k GROUP BY id),
    its AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM hit) GROUP BY id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN cov USING (id) LEFT JOIN its USING (id)
    """
