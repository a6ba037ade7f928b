"""Analytics over tables of model-written SQL, on Spark DataFrames.

Every job takes DataFrames and returns a DataFrame; nothing runs until an action.
"""

from forkline.operators.classify import class_flags, class_sizes, classify, in_any_class
from forkline.operators.clauses import (
    clause_table,
    compare_pairs,
    signatures,
    stage_compare,
    stage_profile,
)
from forkline.operators.diverge import diverge, divergence_profile, token_divergence
from forkline.operators.evaluate import (
    accuracy,
    align_gold,
    attach_db_id,
    evaluate_runs,
    exec_match,
    exec_projection,
    failed_rows,
    join_divergences,
)
from forkline.operators.items import character_items, forget_items, training_defaults
from forkline.operators.losses import preference_loss, retain_loss, sample_nll, unlearn_loss
from forkline.operators.masks import (
    batch_pad,
    batch_pad_pairs,
    build_masks,
    encode_samples,
    mask_coverage,
)
from forkline.operators.normalize import alias_restore, normalize_pairs
from forkline.operators.sampling import (
    pair_sets,
    remaining_failed,
    sample_items,
    seeded_rank,
    source_counts,
    split_sets,
    split_stats,
    take_seeded,
)
from forkline.operators.scores import (
    cosine_pairs,
    mean_pool,
    step_structs,
    step_topk,
    with_token_text,
)
from forkline.schemas import SCHEMAS
from forkline.sources.adapters import adapt_gold, adapt_samples, train_map
from forkline.sources.tables import (
    read_jsonl_tolerant,
    read_positioned,
    read_table,
    with_position,
    write_set,
    write_summary,
)
from forkline.streaming.incremental import append_divergences, run_incremental

__all__ = [name for name in dir() if not name.startswith("_")]
