"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tephra.llm import bpe, langid, mixing, ngram_join, rules, shards, suffix_array, suffix_tree, token_counts, topk
from tephra.llm.frames import documents


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_mix_sources": _mix,
    "op3_shards": shards.query,
    "op4_token_counts": token_counts.query,
    "op5_substring_dedup": suffix_tree.query,
    "op6_quality_rules": rules.query,
    "op7_language_id": langid.query,
    "op8_suffix_array_dedup": suffix_array.query,
    "op9_byte_bpe": bpe.query,
    "op10_exact_top_k": topk.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.classes_sql(),
    "op2_mix_sources": mixing.mix_sql(),
    "op3_shards": shards.shard_sql(),
    "op6_quality_rules": rules.keep_sql(),
    "op10_exact_top_k": topk.top_k_sql(every=topk.EVERY),
}
