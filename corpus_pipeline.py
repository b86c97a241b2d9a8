"""A training-data pipeline over `documents`: each stage works on all that the stage before it kept.

Stages 1 to 4 return the columns of documents; the last adds where each row goes. Every stage is written as Parquet in
the shared folder and read again as the next one's input, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import forget, forget_since, free_name, load, written, written_so_far
from terrane.llm.decontam import clean_documents
from terrane.llm.mixing import mix
from terrane.llm.neardup import near_duplicates
from terrane.llm.quality import kept_documents
from terrane.llm.scan import running
from terrane.llm.sharding import shard_rows

#: Mixing and sharding follow 64-bit hashes that DuckDB does not have; tests compare run() with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps; each row is judged by its own text, and a null or empty one goes."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, rows without one last.

    Rows are numbered in the order of doc_id, text and all other columns, the latter two by hash, and compared by their
    texts under these numbers, so which row stays does not depend on files or tasks. Rows of one doc_id and different
    texts are documents of their own; of rows of one doc_id and text, the first in that order stays. Texts without
    words are like no other: they stay, once for each doc_id and text, and each row without a doc_id.
    """
    one, key, text = free_name(docs, "_one"), "run_" + free_name(docs, "_one"), F.md5(F.coalesce("text", F.lit("")))
    order = [F.col("doc_id").asc_nulls_last(), text, F.md5(F.to_json(F.struct(*docs.columns)))]
    keyed = running(docs.withColumn(one, F.lit(1).cast("long")), order, sums=(one,), name="keyed")
    found = written(near_duplicates(keyed, key), "near-duplicates")
    bare = found.filter("n_shingles = 0").select(F.col("id").alias(key)).join(keyed.select(key, "doc_id", text.alias("_text"), F.col("text").isNull().alias("_null")), key)
    lone = F.when(F.col("doc_id").isNull(), F.col(key))
    bare = bare.groupBy("doc_id", "_text", "_null", lone).agg(F.min(key).alias("_keep")).select("_keep")
    keep = found.filter("kept AND n_shingles > 0").select(F.col("id").alias("_keep")).unionByName(bare)
    return keyed.join(keep, F.col(key) == F.col("_keep"), "left_semi").drop(key, one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages, or too little of them to count.

    Rows without a text or an id stay or go by their own text; repeated rows share one verdict. An empty benchmark or
    an empty table changes nothing.
    """
    return clean_documents(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, each as often as it is drawn, dealt to files by the output shards of the
    splitting tree and in each shard's order.

    A null source is a source; null texts have size 0; rows equal in id, source and text are drawn together.
    """
    return mix(docs).drop("out_shard", "out_order")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with row_number, position, shard and slot, which replace columns of these names.

    Null ids and texts, ties and repeated rows each get a position of their own.
    """
    return shard_rows(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = written_so_far()
        made = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget_since(spark, mark, made)  # what the stage wrote on its way
        forget(docs)  # the stage before; documents themselves are not a table of written()
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
