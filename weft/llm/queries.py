"""The queries of this package and their SQL, by the names under which they are registered."""

from __future__ import annotations

from weft.llm import op1_toxicity, op2_imi, op3_pii, op4_bpe, op5_quality, op6_lm, op7_decontaminate, op8_urls, op9_jaccard, op10_lines, op11_simhash, op12_spelling, op13_alignment

QUERIES = {
    "op1_toxicity": op1_toxicity.op1_toxicity,
    "op2_imi": op2_imi.op2_imi,
    "op3_pii": op3_pii.op3_pii,
    "op4_bpe": op4_bpe.op4_bpe,
    "op5_quality": op5_quality.op5_quality,
    "op6_lm": op6_lm.op6_lm,
    "op7_decontaminate": op7_decontaminate.op7_decontaminate,
    "op8_urls": op8_urls.op8_urls,
    "op9_jaccard": op9_jaccard.op9_jaccard,
    "op10_lines": op10_lines.op10_lines,
    "op11_simhash": op11_simhash.op11_simhash,
    "op12_spelling": op12_spelling.op12_spelling,
    "op13_alignment": op13_alignment.op13_alignment,
}

SQL = {
    "op7_decontaminate": op7_decontaminate.SQL,
    "op8_urls": op8_urls.SQL,
    "op9_jaccard": op9_jaccard.SQL,
    "op10_lines": op10_lines.SQL,
    "op12_spelling": op12_spelling.SQL,
}
