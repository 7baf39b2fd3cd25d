"""Queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from . import automaton, exact, hamming, infill, nearby, packing, passages, prefixes, quality, repeats, secrets, tokenstore, toxicity

QUERIES = {
    "op1_exact_dedup": exact.op1_exact_dedup,
    "op2_token_store": tokenstore.op2_token_store,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_topk_hamming": hamming.op4_topk_hamming,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe_automaton": automaton.op6_bpe_automaton,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_suffix_dedup": repeats.op8_suffix_dedup,
    "op9_minhash_near_dedup": nearby.op9_minhash_near_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_fm_index_passages": passages.op11_fm_index_passages,
    "op12_prefix_trie": prefixes.op12_prefix_trie,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact.OP1_SQL,
    "op4_topk_hamming": hamming.OP4_SQL,
    "op12_prefix_trie": prefixes.OP12_SQL,
    "op13_fill_in_middle": infill.OP13_SQL,
}
