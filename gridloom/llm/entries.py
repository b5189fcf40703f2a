"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from gridloom.llm import chat, lines, merkle, mixing, packing, phrases, quality, rules, simhash, sortmeans, spelling, toxicity, warc

QUERIES = {
    "op1_bradley_terry_quality": quality.op1,
    "op2_reply_tree_chat": chat.op2,
    "op3_simhash_pivots": simhash.op3,
    "op4_site_line_dedup": lines.op4,
    "op5_best_fit_packing": packing.op5,
    "op6_cnn_toxicity": toxicity.op6,
    "op7_merkle_fingerprints": merkle.op7,
    "op8_risk_controlled_rules": rules.op8,
    "op9_warc_derivatives": warc.op9,
    "op10_temperature_mixing": mixing.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_phrase_automata": phrases.op12,
    "op13_sort_means": sortmeans.op13,
}
ORACLES = {"op2_reply_tree_chat": chat.OP2_SQL, "op4_site_line_dedup": lines.OP4_SQL, "op7_merkle_fingerprints": merkle.OP7_SQL, "op8_risk_controlled_rules": rules.OP8_SQL, "op10_temperature_mixing": mixing.OP10_SQL, "op11_spelling_variants": spelling.OP11_SQL, "op12_phrase_automata": phrases.OP12_SQL, "op13_sort_means": sortmeans.OP13_SQL}
