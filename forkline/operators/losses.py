"""Loss arithmetic over token-level loss tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.schemas import UNSCORED


def scored() -> Column:
    """Position 0 has nothing to predict it, and -100 labels do not count."""
    return (F.col("pos") > 0) & (F.col("label_id") != UNSCORED)


def sample_nll(token_loss: DataFrame, keys: tuple[str, ...] = ("sample_id",), masked: bool = True) -> DataFrame:
    """Summed loss per sample for both models; ``masked`` weights by the forget mask."""
    weight = F.coalesce(F.col("forget_mask"), F.lit(1)) if masked else F.lit(1)

    def total(loss: str) -> Column:
        return F.sum(F.when(scored(), F.col(loss) * weight).otherwise(F.lit(0.0)))

    return token_loss.groupBy(*keys).agg(
        total("nll").alias("nll"), total("ref_nll").alias("ref_nll")
    )


def log_sigmoid_neg(x: Column) -> Column:
    """log(sigmoid(-x)) without overflow for any x."""
    return -(F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def preference_term(nll: Column, ref_nll: Column, beta: float) -> Column:
    """Loss of one forget sample; its batch takes the mean."""
    log_ratio = ref_nll - nll
    return F.lit(-2.0 / beta) * log_sigmoid_neg(F.lit(beta) * log_ratio)


def preference_loss(
    token_loss: DataFrame, beta: float = 0.1, keys: tuple[str, ...] = ("batch_id",)
) -> DataFrame:
    """Negative-preference loss per batch of forget samples."""
    per_sample = sample_nll(token_loss, (*keys, "sample_id"))
    term = preference_term(F.col("nll"), F.col("ref_nll"), beta)
    return per_sample.groupBy(*keys).agg(F.avg(term).alias("forget_loss"))


def retain_loss(token_loss: DataFrame, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Mean loss of the scored tokens of a batch."""
    return token_loss.groupBy(*keys).agg(F.avg(F.when(scored(), F.col("nll"))).alias("retain_loss"))


def unlearn_loss(
    token_loss: DataFrame, beta: float = 0.1, alpha: float = 1.0, gamma: float = 1.0
) -> DataFrame:
    """``batch_id, forget_loss, retain_loss, total_loss`` from one scan and no join.

    Sums per (batch, side, sample) first, then per batch; both are combined before
    their shuffle, so a very long sample or batch is only a few numbers when it moves.
    """
    forget = F.col("side") == "forget"
    weight = F.when(forget, F.coalesce(F.col("forget_mask"), F.lit(1))).otherwise(F.lit(1))

    def total(value: Column) -> Column:
        return F.sum(F.when(scored(), value * weight).otherwise(F.lit(0.0)))

    samples = token_loss.groupBy("batch_id", "side", "sample_id").agg(
        total(F.col("nll")).alias("nll"),
        total(F.col("ref_nll")).alias("ref_nll"),
        F.count_if(scored()).alias("n"),
    )
    term = preference_term(F.col("nll"), F.col("ref_nll"), beta)
    kept = ~forget
    batches = samples.groupBy("batch_id").agg(
        F.avg(F.when(forget, term)).alias("forget_loss"),
        F.try_divide(F.sum(F.when(kept, F.col("nll"))), F.sum(F.when(kept, F.col("n")))).alias(
            "retain_loss"
        ),
    )
    total_loss = F.lit(gamma) * F.col("forget_loss") + F.lit(alpha) * F.col("retain_loss")
    return batches.withColumn("total_loss", total_loss)
