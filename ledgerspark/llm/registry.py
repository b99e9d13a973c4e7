"""Queries of the operators and the SQL of those that SQL can express."""

from . import ann, chat, hnsw, lbl, mixing, packing, quality, repair, secret_scan, simhash, toxicity, trie, whitening

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op3_embedding_near_dedup": hnsw.query,
    "op2_token_files": repair.query,
    "op4_chat_formatting": chat.query,
    "op5_quality_classifier": quality.query,
    "op6_best_fit_packing": packing.query,
    "op7_secret_scan": secret_scan.query,
    "op8_lm_scoring": lbl.query,
    "op10_nearest_neighbours": ann.query,
    "op9_source_mixing": mixing.query,
    "op11_conversation_trie": trie.query,
    "op12_toxicity": toxicity.query,
    "op13_embedding_whitening": whitening.query,
}
ORACLE = {"op4_chat_formatting": chat.SQL, "op3_embedding_near_dedup": hnsw.SQL, "op7_secret_scan": secret_scan.SQL, "op9_source_mixing": mixing.SQL, "op11_conversation_trie": trie.SQL}
