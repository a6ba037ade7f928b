"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from forkline.llm import centroids, decontaminate, frames, licenses, linecrf, packing, pii, quality, recurrent, simhash, tokenfile, topk, urls

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_license_scans": licenses.op2_license_scans,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_lm_scoring": recurrent.op4_lm_scoring,
    "op5_url_filters": urls.op5_url_filters,
    "op6_token_files": tokenfile.op6_token_files,
    "op7_simhash": simhash.op7_simhash,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_pii": pii.op9_pii,
    "op10_quality_classifier": linecrf.op10_quality_classifier,
    "op11_exact_topk_search": topk.op11_exact_topk_search,
    "op12_fill_in_middle": frames.op12_fill_in_middle,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}
ORACLES = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op3_quality_rules": quality.OP3_SQL,
    "op5_url_filters": urls.OP5_SQL,
    "op11_exact_topk_search": topk.OP11_SQL,
    "op12_fill_in_middle": frames.OP12_SQL,
    "op13_centroid_clustering": centroids.OP13_SQL,
}
