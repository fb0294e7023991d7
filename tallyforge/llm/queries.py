"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from tallyforge.llm import (byte_bpe, collocations, html_text, jaccard, masked_lm, mixing, mtree, neighbour_graph,
                            packing, substrings, token_files, toxicity, whitening)

QUERIES = {
    "op1_substrings": substrings.op1_substrings,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_mtree": mtree.op3_mtree,
    "op4_mix": mixing.op4_mix,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_neighbour_graph": neighbour_graph.op6_neighbour_graph,
    "op7_html_text": html_text.op7_html_text,
    "op8_masked_lm": masked_lm.op8_masked_lm,
    "op9_pack": packing.op9_pack,
    "op10_token_files": token_files.op10_token_files,
    "op11_collocations": collocations.op11_collocations,
    "op12_whitening": whitening.op12_whitening,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLE = {
    "op1_substrings": substrings.SQL,
    "op2_jaccard": jaccard.SQL,
    "op3_mtree": mtree.SQL,
    "op4_mix": mixing.SQL,
    "op11_collocations": collocations.SQL,
}
