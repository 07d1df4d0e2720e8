"""The corpus queries: name to function of (spark, sf_dir), and name to DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_quality_rules": "quality_rules",
    "op2_token_counts": "token_counts",
    "op3_mix_sources": "mixing",
    "op4_topk_threshold": "topk_search",
    "op5_label_propagation_shards": "sharding",
    "op6_quality_crf": "quality_crf",
    "op7_secret_scans": "secret_scans",
    "op8_bpe_automaton": "bpe_automaton",
    "op9_ngram_jaccard": "ngram_jaccard",
    "op10_substring_dedup": "substring_dedup",
    "op11_fill_in_middle": "fill_in_middle",
    "op12_personal_data": "personal_data",
    "op13_centroid_clustering": "centroid_clustering",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
