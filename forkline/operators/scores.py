"""Softmax with top-k over score tables, pooled vectors and similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forkline.functions.vectors import cosine
from forkline.operators.diverge import clean_marker

# Scores are grouped by this width before exponentiation: exp(64) is far from overflow.
WIDTH = 64


def softmax_mass(step_scores: DataFrame) -> DataFrame:
    """``step_id, shift, mass`` with softmax(score) = exp(score - shift) / mass.

    Sums are kept per band of scores, each relative to the band's own floor, so one
    combined aggregate replaces a maximum per step joined back to every score.  Scores
    of minus infinity have probability zero and add nothing.
    """
    band = F.floor(F.col("score") / WIDTH)
    finite = F.col("score") > F.lit(float("-inf"))
    bands = (
        step_scores.filter(finite)
        .select("step_id", band.alias("_band"), (F.col("score") - band * WIDTH).alias("_rest"))
        .groupBy("step_id", "_band")
        .agg(F.sum(F.exp("_rest")).alias("_sum"))
    )
    top = F.max("_band").over(Window.partitionBy("step_id"))
    scale = F.exp((F.col("_band") - F.col("_top")) * F.lit(float(WIDTH)))
    return (
        bands.withColumn("_top", top)
        .groupBy("step_id")
        .agg(
            (F.max("_top") * F.lit(float(WIDTH))).alias("shift"),
            F.sum(F.col("_sum") * scale).alias("mass"),
        )
    )


def step_topk(step_scores: DataFrame, k: int = 5) -> DataFrame:
    """``step_id, token_id, prob, rank``: the k likeliest tokens of each step.

    Spark cuts each task's rows to k per step before the shuffle, as the filter is a
    ``row_number() <= k``; ties go to the smaller token id.
    """
    order = Window.partitionBy("step_id").orderBy(F.desc("score"), "token_id")
    best = step_scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    prob = F.exp(F.col("score") - F.col("shift")) / F.col("mass")
    return best.join(softmax_mass(step_scores), "step_id").select(
        "step_id", "token_id", prob.alias("prob"), "rank"
    )


def with_token_text(topk: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add the cleaned text of each token from ``vocabulary(token_id, token)``."""
    names = vocabulary.select("token_id", clean_marker(F.col("token")).alias("token"))
    return topk.join(names, "token_id", "left")


def step_structs(topk: DataFrame, generated: DataFrame) -> DataFrame:
    """One row per step with its k tokens in arrays, ordered by rank.

    ``topk`` carries token texts, ``generated`` has ``step_id, step, token_id, token``.
    An array holds k entries at most, however many scores the step had.
    """
    entry = F.struct("rank", "token", "token_id", "prob")
    ordered = F.array_sort(F.collect_list(entry))
    lists = topk.groupBy("step_id").agg(ordered.alias("_top"))
    return lists.join(generated, "step_id").select(
        "step_id",
        F.struct(
            F.col("step").cast("int").alias("step"),
            clean_marker(F.col("token")).alias("generated_token"),
            F.col("token_id").alias("generated_token_id"),
            F.col("_top.token").alias("top5_tokens"),
            F.col("_top.token_id").alias("top5_token_ids"),
            F.col("_top.prob").alias("top5_probs"),
        ).alias("step_top5"),
    )


def mean_pool(vectors: DataFrame, key: str = "id") -> DataFrame:
    """Mean vector per key over rows with mask 1.

    Sums per (key, dimension) are combined before the shuffle, so a key with very many
    vectors moves one number per dimension and task; only ``dim`` numbers of a key
    are put together at the end.
    """
    kept = vectors.filter(F.col("mask") == 1)
    flat = kept.select(key, F.posexplode("embedding").alias("_dim", "_x"))
    means = flat.groupBy(key, "_dim").agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    ordered = F.array_sort(F.collect_list(F.struct("_dim", "_mean")))
    return means.groupBy(key).agg(F.transform(ordered, lambda e: e["_mean"]).alias("embedding"))


def cosine_pairs(pairs: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Similarity of each ``a, b`` pair of keys."""
    left = vectors.select(F.col(key).alias("a"), F.col("embedding").alias("_va"))
    right = vectors.select(F.col(key).alias("b"), F.col("embedding").alias("_vb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("similarity", cosine(F.col("_va"), F.col("_vb")))
        .drop("_va", "_vb")
    )
