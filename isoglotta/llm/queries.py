"""Registered queries of this subpackage."""

from . import chat_format, decontaminate, exact_dedup, html_extract, lm_score, near_dedup, packing, token_files, toxicity, url_filter

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_token_files": token_files.op6_token_files,
    "op7_pitman_yor_lm": lm_score.op7_pitman_yor_lm,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
}
ORACLES = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op4_url_filter": url_filter.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_benchmark_decontamination": decontaminate.ORACLE_SQL,
}
