"""Registered queries of the subpackage, with their DuckDB SQL where there is one."""
from __future__ import annotations

from . import op01_token_counts, op02_tree_merge, op03_prefix_free, op04_toxicity, op05_projection_forest, op06_sentencepiece, op07_lattice_lm, op08_relative_lz, op09_source_schedule, op10_parity_sketch, op11_filter_audit, op12_prefix_trie, op13_token_files

QUERIES = {
    "op1_token_counts": op01_token_counts.op1_token_counts,
    "op2_tree_merge": op02_tree_merge.op2_tree_merge,
    "op3_prefix_free_dedup": op03_prefix_free.op3_prefix_free_dedup,
    "op4_toxicity": op04_toxicity.op4_toxicity,
    "op5_projection_forest": op05_projection_forest.op5_projection_forest,
    "op6_sentencepiece": op06_sentencepiece.op6_sentencepiece,
    "op7_lattice_lm": op07_lattice_lm.op7_lattice_lm,
    "op8_relative_lz": op08_relative_lz.op8_relative_lz,
    "op9_source_schedule": op09_source_schedule.op9_source_schedule,
    "op10_parity_sketch": op10_parity_sketch.op10_parity_sketch,
    "op11_filter_audit": op11_filter_audit.op11_filter_audit,
    "op12_prefix_trie": op12_prefix_trie.op12_prefix_trie,
    "op13_token_files": op13_token_files.op13_token_files,
}

ORACLE = {
    "op2_tree_merge": op02_tree_merge.SQL,
    "op5_projection_forest": op05_projection_forest.SQL,
    "op8_relative_lz": op08_relative_lz.SQL,
    "op9_source_schedule": op09_source_schedule.SQL,
    "op10_parity_sketch": op10_parity_sketch.SQL,
    "op11_filter_audit": op11_filter_audit.SQL,
    "op12_prefix_trie": op12_prefix_trie.SQL,
}
