"""The queries of this subpackage by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runledger.llm import (
    debruijn,
    decontamination,
    language,
    minhash,
    ngram_join,
    oracles,
    packing,
    pii,
    prefix_trie,
    quality,
    spelling,
    suffix_dedup,
    token_files,
    toxicity,
)
from runledger.llm.storage import over_tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": over_tables(ngram_join.join, "documents"),
        "op2_pii_spans": over_tables(pii.digest, "documents"),
        "op3_best_fit_packing": over_tables(packing.pack, "documents"),
        "op4_language_id": over_tables(language.identify, "documents"),
        "op5_quality_rules": over_tables(quality.judge, "documents", "labels"),
        "op6_token_files": over_tables(token_files.round_trip, "documents"),
        "op7_toxicity": over_tables(toxicity.score, "documents", "labels"),
        "op8_suffix_array_dedup": over_tables(suffix_dedup.remove_repeats, "documents"),
        "op9_decontamination": over_tables(decontamination.contamination, "documents", "benchmark"),
        "op10_substring_dedup": over_tables(debruijn.remove_repeats, "documents"),
        "op11_spelling_variants": over_tables(spelling.group_spellings, "documents"),
        "op12_prefix_trie": over_tables(prefix_trie.conversation_tree, "conversations"),
        "op13_minhash_dedup": over_tables(minhash.deduplicate, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
