"""One explicit schema per table, as DDL text; nothing is inferred.

Inference would turn the alias maps into structs with one field per table name.
"""

from __future__ import annotations

_STEP = (
    "step: int, generated_token: string, generated_token_id: bigint, "
    "top5_tokens: array<string>, top5_token_ids: array<bigint>, top5_probs: array<double>"
)
_META = (
    "norm_div_index: int, norm_pred_token: string, norm_label_token: string, "
    "norm_pred_char: int, orig_pred_char: int, orig_pred_token: string, "
    "orig_pred_token_index: int, reason: string"
)
_PREDICTION = "index bigint, prompt string, predict string, label string"
_SIGNATURE = (
    "tables: array<string>, joins: array<string>, filters: array<string>, "
    "group_by: array<string>, having: array<string>, `select`: array<string>, "
    "order_by: array<string>, `limit`: bigint"
)

STEP_TYPE = f"struct<{_STEP}>"
META_TYPE = f"struct<{_META}>"
SIGNATURE_TYPE = f"struct<{_SIGNATURE}>"

SCHEMAS: dict[str, str] = {
    "sft_samples": ("id string, instruction string, input string, output string"),
    "qa_items": (
        "id string, question string, answer string, "
        "forget_tail string, forget_part string, forget_mode string"
    ),
    "predictions": (_PREDICTION),
    "divergences": (
        f"{_PREDICTION}, normalized_predict string, normalized_label string, "
        "predict_aliases map<string,string>, label_aliases map<string,string>, "
        "prefix string, suffix string, semantic_divergence string, "
        f"divergence_meta {META_TYPE}, logits_top5 array<{STEP_TYPE}>"
    ),
    "exec_results": (
        f"{_PREDICTION}, exec_match boolean, error string, gold_sql string, "
        "`schema` string, nl string, db_id string"
    ),
    "result_rows": ("index bigint, side string, vals array<string>"),
    "run_status": (
        "index bigint, pred_error string, gold_error string, pred_parse_error string, gold_parse_error string"
    ),
    "forget_items": (
        "id string, question string, answer string, db_id string, answer_source string, "
        "original_exec_match boolean, original_error string, forget_tail string, "
        "forget_mode string, forget_part string"
    ),
    "split_items": (
        "id string, question string, answer string, answer_source string, "
        "original_exec_match boolean, original_error string"
    ),
    "encoded": (
        "input_ids array<int>, attention_mask array<int>, labels array<int>, forget_mask array<int>"
    ),
    "train_items": ("id string, query string, sql string, db_id string"),
    "train_map": ("key string, db_id string"),
    "token_loss": (
        "batch_id bigint, side string, sample_id bigint, pos bigint, label_id bigint, "
        "forget_mask int, nll double, ref_nll double"
    ),
    "step_scores": ("step_id bigint, token_id bigint, score double"),
    "token_vectors": ("token string, embedding array<double>"),
}

# A label that is not scored, and what stands for an empty remainder.
UNSCORED = -100
END_OF_TURN = "<|eot_id|>"
