"""The queries of this package, and the SQL of those that SQL can say."""

from __future__ import annotations

from tapelab.llm import chat, heavy_dedup, kd_search, language_id, minhash_join, mixing, packing, prefix_trie, repeated_spans, sharding, simhash, spelling, url_cascade

QUERIES = {
    "op1_virtual_slot_sharding": sharding.query,
    "op2_minhash_jaccard_join": minhash_join.query,
    "op3_least_squares_packing": packing.query,
    "op4_bitmask_language_id": language_id.query,
    "op5_prefix_target_chat": chat.query,
    "op6_heavy_hitter_dedup": heavy_dedup.query,
    "op7_debruijn_span_dedup": repeated_spans.query,
    "op8_bloom_cascade_urls": url_cascade.query,
    "op9_kd_tree_top_k": kd_search.query,
    "op10_sainte_lague_mix": mixing.query,
    "op11_edit_transducer_spelling": spelling.query,
    "op12_simhash_popcount_grid": simhash.query,
    "op13_prefix_trie_contraction": prefix_trie.query,
}

ORACLES = {
    "op2_minhash_jaccard_join": minhash_join.SQL,
    "op5_prefix_target_chat": chat.SQL,
    "op6_heavy_hitter_dedup": heavy_dedup.SQL,
    "op7_debruijn_span_dedup": repeated_spans.SQL,
    "op8_bloom_cascade_urls": url_cascade.SQL,
    "op9_kd_tree_top_k": kd_search.SQL,
    "op10_sainte_lague_mix": mixing.SQL,
    "op11_edit_transducer_spelling": spelling.SQL,
    "op13_prefix_trie_contraction": prefix_trie.SQL,
}
