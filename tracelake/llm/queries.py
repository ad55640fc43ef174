"""The queries of this package and, where SQL can express them, their SQL."""

from . import decontamination, licenses, lines, pii, quality, runs, search, segment, simhash, substrings, tokens, topk, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_pii": pii.op5_pii,
    "op6_top_k": topk.op6_top_k,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_segment": segment.op10_segment,
    "op11_runs": runs.op11_runs,
    "op12_token_counts": tokens.op12_token_counts,
    "op13_search": search.op13_search,
}
ORACLE_SQL = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op2_license_scan": licenses.OP2_SQL,
    "op3_line_dedup": lines.OP3_SQL,
    "op6_top_k": topk.OP6_SQL,
    "op9_substring_dedup": substrings.OP9_SQL,
    "op13_search": search.OP13_SQL,
}
