"""Differing input shapes brought to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.functions.prompts import input_fields, question_fields
from forkline.functions.text import collapse_spaces, text_or_empty


def adapt_samples(samples: DataFrame, shape: str) -> DataFrame:
    """``id, question, answer`` from question/answer or instruction/input/output rows."""
    key = F.coalesce("id", F.lit("unknown")).alias("id")
    if shape == "qa":
        return samples.select(key, "question", text_or_empty(F.col("answer")).alias("answer"))
    if shape == "sft":
        question = F.concat(
            text_or_empty(F.col("instruction")), F.lit("\n"), text_or_empty(F.col("input"))
        )
        return samples.select(
            key, question.alias("question"), text_or_empty(F.col("output")).alias("answer")
        )
    raise ValueError(f"unknown sample shape {shape!r}")


def adapt_gold(samples: DataFrame) -> DataFrame:
    """Add ``gold``, ``schema`` and ``nl``; rows of neither shape are dropped.

    Input and output win over question and answer when a row has both.
    """
    sft = F.col("input").isNotNull() & F.col("output").isNotNull()
    qa = F.col("question").isNotNull() & F.col("answer").isNotNull()
    fields = F.when(sft, input_fields(F.col("input"))).otherwise(question_fields(F.col("question")))
    return (
        samples.filter(sft | qa)
        .withColumn("_fields", fields)
        .withColumns(
            {
                "gold": F.when(sft, F.col("output")).otherwise(F.col("answer")),
                "schema": F.col("_fields.schema"),
                "nl": F.col("_fields.nl"),
            }
        )
        .drop("_fields")
    )


def train_map(items: DataFrame, by: str = "position") -> DataFrame:
    """``key, db_id``: by row position, or by the SQL of field ``by`` with its white space
    collapsed.  Of equal keys the later row wins; ``max_by`` combines before the shuffle.
    """
    if by == "position":
        return items.select(F.col("index").cast("string").alias("key"), "db_id")
    known = items.filter(F.col(by).isNotNull() & F.col("db_id").isNotNull())
    return known.groupBy(collapse_spaces(F.col(by)).alias("key")).agg(
        F.max_by("db_id", "index").alias("db_id")
    )
