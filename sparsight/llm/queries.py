"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from sparsight.llm import (
    context_tree, conversations, decontamination, html_text, lexical, line_dedup, packing, quality_model, quality_rules, sharding, simhash,
    url_rules, warc,
)

QUERIES = {
    "op1_simhash_pivots": simhash.op1_simhash_pivots,
    "op2_suffix_automaton": decontamination.op2_suffix_automaton,
    "op3_site_templates": html_text.op3_site_templates,
    "op4_warc": warc.op4_warc,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_context_tree": context_tree.op6_context_tree,
    "op7_hilbert_shards": sharding.op7_hilbert_shards,
    "op8_pattern_packing": packing.op8_pattern_packing,
    "op9_line_first": quality_rules.op9_line_first,
    "op10_additive_model": quality_model.op10_additive_model,
    "op11_pair_maxscore": lexical.op11_pair_maxscore,
    "op12_url_expressions": url_rules.op12_url_expressions,
    "op13_run_length_repair": conversations.op13_run_length_repair,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_suffix_automaton": decontamination.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op9_line_first": quality_rules.OP9_SQL,
    "op11_pair_maxscore": lexical.OP11_SQL,
    "op12_url_expressions": url_rules.OP12_SQL,
    "op13_run_length_repair": conversations.OP13_SQL,
}
