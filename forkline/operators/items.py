"""Training items from failed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.functions.prompts import question_strict
from forkline.functions.text import common_prefix_length, first_word, let, text_or_empty
from forkline.operators.evaluate import strictly_failed
from forkline.schemas import END_OF_TURN


def leading_part(tail: Column, default: str) -> Column:
    """First word of the tail, else its first character, else ``default``."""
    return F.coalesce(first_word(tail), F.nullif(F.left(tail, F.lit(1)), F.lit("")), F.lit(default))


def forget_items(classified: DataFrame, mode: str = "First") -> DataFrame:
    """One item per class of a row.  Narrow: ``classes`` is exploded last.

    First names the first word of the tail as the part, Whole the tail itself.
    """
    if mode not in ("First", "Whole"):
        raise ValueError(f"mode must be First or Whole, not {mode!r}")
    tail = text_or_empty(F.col("suffix"))
    part = tail if mode == "Whole" else leading_part(tail, END_OF_TURN)
    return classified.select(
        F.col("index").cast("string").alias("id"),
        question_strict(text_or_empty(F.col("prompt"))).alias("question"),
        text_or_empty(F.col("predict")).alias("answer"),
        F.coalesce("db_id", F.lit("")).alias("db_id"),
        F.lit("predict").alias("answer_source"),
        F.lit(False).alias("original_exec_match"),
        tail.alias("forget_tail"),
        F.lit(mode).alias("forget_mode"),
        part.alias("forget_part"),
        F.explode("classes").alias("error_class"),
    )


def character_tail(predict: Column, label: Column) -> Column:
    """The prediction from its first differing character, all of it when they are equal."""
    rest = let(
        common_prefix_length(predict, label),
        lambda n: predict.substr(n + 1, F.length(predict)),
    )
    return F.when(predict == label, predict).otherwise(rest)


def character_items(exec_results: DataFrame) -> DataFrame:
    """Items cut at the first differing character: a First and a Whole row each."""
    tail = F.col("forget_tail")
    base = strictly_failed(exec_results).select(
        F.col("index").cast("string").alias("id"),
        question_strict(text_or_empty(F.col("prompt"))).alias("question"),
        text_or_empty(F.col("predict")).alias("answer"),
        F.coalesce("db_id", F.lit("")).alias("db_id"),
        F.lit("predict").alias("answer_source"),
        F.col("exec_match").alias("original_exec_match"),
        F.col("error").alias("original_error"),
        character_tail(text_or_empty(F.col("predict")), text_or_empty(F.col("label"))).alias(
            "forget_tail"
        ),
    )
    modes = F.array(
        F.struct(F.lit("First").alias("mode"), leading_part(tail, "").alias("part")),
        F.struct(F.lit("Whole").alias("mode"), tail.alias("part")),
    )
    return base.withColumn("_m", F.explode(modes)).select(
        *base.columns, F.col("_m.mode").alias("forget_mode"), F.col("_m.part").alias("forget_part")
    )


def training_defaults(items: DataFrame) -> DataFrame:
    """Missing mode is First; a missing id is the row position ``index``."""
    return items.withColumns(
        {
            "forget_mode": F.coalesce("forget_mode", F.lit("First")),
            "id": F.coalesce("id", F.col("index").cast("string")),
        }
    )
