"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from corpuskit.llm import alignment, domain, fingerprints, language, licenses, mixing, neardup, pieces, quality, resampling, substrings, topk, warc

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_warc": warc.op2_warc,
    "op3_licenses": licenses.op3_licenses,
    "op4_substrings": substrings.op4_substrings,
    "op5_neardup": neardup.op5_neardup,
    "op6_mixing": mixing.op6_mixing,
    "op7_topk": topk.op7_topk,
    "op8_language": language.op8_language,
    "op9_pieces": pieces.op9_pieces,
    "op10_domain": domain.op10_domain,
    "op11_resampling": resampling.op11_resampling,
    "op12_alignment": alignment.op12_alignment,
    "op13_quality": quality.op13_quality,
}

ORACLES = {
    "op2_warc": warc.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_topk": topk.ORACLE,
    "op11_resampling": resampling.ORACLE,
}
