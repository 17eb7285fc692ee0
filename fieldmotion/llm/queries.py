"""The queries of this subpackage and the SQL that must agree where SQL can say it."""

from __future__ import annotations

from fieldmotion.llm import (
    best_fit_packing, block_neighbours, block_search, co_training, flow_reshard, hyper_language, line_blocks, log_bilinear, lsh_forest,
    ngram_jaccard, prefix_trie, systematic_mix, weak_rules,
)

QUERIES = {
    "op1_ngram_jaccard_join": ngram_jaccard.op1_query,
    "op2_line_blocks": line_blocks.op2_query,
    "op3_best_fit_packing": best_fit_packing.op3_query,
    "op4_co_training": co_training.op4_query,
    "op5_block_neighbours": block_neighbours.op5_query,
    "op6_flow_reshard": flow_reshard.op6_query,
    "op7_log_bilinear": log_bilinear.op7_query,
    "op8_systematic_mix": systematic_mix.op8_query,
    "op9_weak_rules": weak_rules.op9_query,
    "op10_hyper_language": hyper_language.op10_query,
    "op11_prefix_trie": prefix_trie.op11_query,
    "op12_block_search": block_search.op12_query,
    "op13_lsh_forest": lsh_forest.op13_query,
}
ORACLE = {
    "op1_ngram_jaccard_join": ngram_jaccard.OP1_SQL,
    "op5_block_neighbours": block_neighbours.OP5_SQL,
    "op8_systematic_mix": systematic_mix.OP8_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_block_search": block_search.OP12_SQL,
    "op13_lsh_forest": lsh_forest.OP13_SQL,
}
