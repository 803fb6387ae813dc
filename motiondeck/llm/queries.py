"""Registered queries of the text operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from motiondeck.llm import hard_negatives, host_rules
from motiondeck.llm.hard_negatives import op13_hard_negatives
from motiondeck.llm.host_rules import op10_host_rules
from motiondeck.llm.interpolation import op11_deleted_interpolation
from motiondeck.llm.lang_ecoc import op2_lang_ecoc
from motiondeck.llm.line_dedup import op4_line_simhash
from motiondeck.llm.ngram_join import op3_ngram_trie_join
from motiondeck.llm.order_minhash import op6_order_minhash
from motiondeck.llm.packing import op7_residual_packing
from motiondeck.llm.page_diff import op5_page_diff
from motiondeck.llm.piece_nbest import op1_piece_nbest
from motiondeck.llm.quality_gam import op8_quality_gam
from motiondeck.llm.token_align import op12_token_align
from motiondeck.llm.toxicity import op9_toxicity_subwords

QUERIES = {
    "op1_piece_nbest": op1_piece_nbest,
    "op2_lang_ecoc": op2_lang_ecoc,
    "op3_ngram_trie_join": op3_ngram_trie_join,
    "op4_line_simhash": op4_line_simhash,
    "op5_page_diff": op5_page_diff,
    "op6_order_minhash": op6_order_minhash,
    "op7_residual_packing": op7_residual_packing,
    "op8_quality_gam": op8_quality_gam,
    "op9_toxicity_subwords": op9_toxicity_subwords,
    "op10_host_rules": op10_host_rules,
    "op11_deleted_interpolation": op11_deleted_interpolation,
    "op12_token_align": op12_token_align,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {"op10_host_rules": host_rules.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
