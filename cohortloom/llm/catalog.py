"""The queries of this subpackage and their SQL."""

from cohortloom.llm import chat, infill, licenses, mixing, ngram, packing, permutation, quality_classifier, quality_rules, simhash, topk, url_filter, whitening

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_lm_score": ngram.op2_lm_score,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_packing": packing.op9_packing,
    "op10_chat_format": chat.op10_chat_format,
    "op11_permutation_index": permutation.op11_permutation_index,
    "op12_infill": infill.op12_infill,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {
    "op1_topk": topk.SQL,
    "op4_license_scan": licenses.sql(),
    "op7_mixing": mixing.SQL,
    "op12_infill": infill.SQL,
}
