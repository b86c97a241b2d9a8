"""The queries of this subpackage over the synthetic tables, and their DuckDB oracles where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.llm.common import load
from terrane.llm.conversations import op12_sql, op12_trie
from terrane.llm.decontam import op9_decontam, op9_sql
from terrane.llm.interactions import op11_audit, op11_sql
from terrane.llm.langid import op6_language
from terrane.llm.licenses import op5_expressions, op5_expressions_sql, op5_licenses, op5_sql
from terrane.llm.linededup import op4_lines, op4_sql
from terrane.llm.mixing import mix_targets, mix_targets_sql, op10_mix
from terrane.llm.neardup import op3_neardup, op3_sql
from terrane.llm.ngramjoin import op13_join, op13_sql
from terrane.llm.quality import op2_ablations, op2_ablations_sql, op2_quality, op2_sql
from terrane.llm.secret_scan import base_spans, base_spans_sql, op7_secrets
from terrane.llm.sharding import op1_shards, op1_sql
from terrane.llm.urlfilter import op8_listed, op8_listed_sql, op8_sql, op8_urls


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*(load(spark, sf_dir, t) for t in tables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": _over(op1_shards, "documents"),
        "op2_quality_rules": _over(op2_quality, "documents"),
        "op3_minhash_neardup": _over(op3_neardup, "documents"),
        "op4_line_dedup": _over(op4_lines, "documents"),
        "op5_license_scan": _over(op5_licenses, "documents"),
        "op6_language_id": _over(op6_language, "documents"),
        "op7_secret_scan": _over(op7_secrets, "documents"),
        "op8_url_filter": _over(op8_urls, "pages"),
        "op9_decontamination": _over(op9_decontam, "documents", "benchmark"),
        "op10_mixing": _over(op10_mix, "documents"),
        "op11_filter_audit": _over(op11_audit, "documents", "labels"),
        "op12_prefix_trie": _over(op12_trie, "conversations"),
        "op13_ngram_join": _over(op13_join, "documents"),
        # more of what operators find, where SQL can check it
        "quality_ablations": _over(op2_ablations, "documents"),
        "license_expressions": _over(op5_expressions, "documents"),
        "secret_base_spans": _over(base_spans, "documents"),
        "urls_by_tables": _over(op8_listed, "pages", "customer"),
        "mix_targets": _over(mix_targets, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": op1_sql(),
        "op2_quality_rules": op2_sql(),
        "op3_minhash_neardup": op3_sql(),
        "op4_line_dedup": op4_sql(),
        "op5_license_scan": op5_sql(),
        "op8_url_filter": op8_sql(),
        "op9_decontamination": op9_sql(),
        "op11_filter_audit": op11_sql(),
        "op12_prefix_trie": op12_sql(),
        "op13_ngram_join": op13_sql(),
        "quality_ablations": op2_ablations_sql(),
        "license_expressions": op5_expressions_sql(),
        "secret_base_spans": base_spans_sql(),
        "urls_by_tables": op8_listed_sql(),
        "mix_targets": mix_targets_sql(),
    }
