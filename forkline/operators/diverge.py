"""Where a prediction leaves its gold text, in tokens, characters, words and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.functions import sqltext
from forkline.functions.text import (
    WS,
    collapse_spaces,
    let,
    strip,
    text_or_empty,
    words,
    words_before,
)
from forkline.schemas import META_TYPE, STEP_TYPE


def token_divergence(normalized: DataFrame) -> DataFrame:
    """Add ``pred_tokens``, ``gold_tokens``, ``div_index`` (-1: none) and ``reason``."""
    pred, gold, at = F.col("pred_tokens"), F.col("gold_tokens"), F.col("div_index")
    return (
        normalized.withColumns(
            {
                "pred_tokens": sqltext.tokens(F.col("normalized_predict")),
                "gold_tokens": sqltext.tokens(F.col("normalized_label")),
            }
        )
        .withColumn("div_index", sqltext.first_divergence(pred, gold))
        .withColumn("reason", sqltext.divergence_reason(at, pred, gold))
    )


def clean_marker(token: Column) -> Column:
    """Drop the leading-space marker that some vocabularies write as a letter."""
    return strip(F.replace(text_or_empty(token), F.lit("Ġ"), F.lit(" ")))


def divergence_step(pieces: Column, prefix: Column) -> Column:
    """The step after the one whose text completes ``prefix``.

    ``pieces`` is the text each step added, '' for special tokens.  One fold keeps the
    collapsed length so far; from the first occurrence of the prefix on, a step counts
    while the text so far still ends with the prefix.
    """

    def locate(text: Column, wanted: Column) -> Column:
        found = F.instr(text, wanted)
        end = F.when(found > 0, found + F.length(wanted) - 1).otherwise(F.lit(2**31 - 1))
        # Bound once: a lambda evaluates what it captures for every element.
        sizes = F.struct(F.length(wanted).alias("size"), end.alias("end"))
        return let(sizes, lambda bound: scan(text, wanted, bound["size"], bound["end"]))

    def scan(text: Column, wanted: Column, size: Column, first_end: Column) -> Column:
        def step(state: Column, raw: Column) -> Column:
            def with_core(core: Column) -> Column:
                blank = core == ""
                gap = (state["open"] | F.rlike(raw, F.lit(f"(?U)^{WS}"))) & (state["len"] > 0)
                reach = F.when(blank, state["len"]).otherwise(
                    state["len"] + gap.cast("int") + F.length(core)
                )
                still_open = F.when(blank, state["open"] | (raw != "")).otherwise(
                    F.rlike(raw, F.lit(f"(?U){WS}$"))
                )

                def advance(length: Column) -> Column:
                    looking = (length >= first_end) & ~state["done"]
                    ends = text.substr(length - size + 1, size) == wanted
                    return F.struct(
                        length.cast("int").alias("len"),
                        still_open.alias("open"),
                        (state["k"] + 1).alias("k"),
                        F.when(looking & ends, state["k"] + 1).otherwise(state["last"]).alias("last"),
                        (state["done"] | (looking & ~ends)).alias("done"),
                    )

                return let(reach, advance)

            return let(collapse_spaces(raw), with_core)

        start = F.struct(
            F.lit(0).alias("len"),
            F.lit(False).alias("open"),
            F.lit(0).alias("k"),
            F.lit(-1).alias("last"),
            F.lit(False).alias("done"),
        )
        final = F.size(pieces) - 1
        return F.aggregate(
            pieces,
            start,
            step,
            lambda s: F.when(s["last"] >= 0, F.least(s["last"], final)).otherwise(final),
        )

    collapsed = collapse_spaces(F.array_join(pieces, ""))
    wanted = collapse_spaces(prefix)
    found = let(collapsed, lambda text: let(wanted, lambda p: locate(text, p)))
    return F.when((F.size(pieces) <= 0) | (wanted == ""), F.lit(0)).otherwise(found)


def diverge(
    normalized: DataFrame, steps: str | None = None, pieces: str | None = None
) -> DataFrame:
    """Add prefix, suffix, divergence_meta and logits_top5 to normalised pairs.

    ``steps`` names an array of step structs, ``pieces`` the array of texts the steps
    added, of the same length.  Narrow: no shuffle, no Python.
    """
    raw = F.col("predict")
    at, off, cut, raw_words = (F.col(c) for c in ("div_index", "_off", "_cut", "_words"))
    diverged = F.col("_diverged")
    out = (
        token_divergence(normalized)
        .withColumn("_diverged", (at >= 0) & (at < F.size("pred_tokens")))
        .withColumns(
            {
                "_off": F.when(diverged, sqltext.raw_token_offset(raw, at)),
                "_norm": F.when(diverged, sqltext.token_offset(F.col("normalized_predict"), at)),
                "_words": words(raw),
            }
        )
        .withColumn("_cut", F.when(diverged, words_before(raw, off)))
        .withColumns(
            {
                "prefix": F.when(diverged, F.array_join(F.slice(raw_words, F.lit(1), cut), " ")).otherwise(
                    strip(raw)
                ),
                "suffix": F.when(
                    diverged, F.array_join(F.slice(raw_words, cut + 1, F.size(raw_words)), " ")
                ).otherwise(F.lit("")),
                "semantic_divergence": F.lit(None).cast("string"),
                "divergence_meta": F.when(
                    diverged,
                    F.struct(
                        at.alias("norm_div_index"),
                        F.get("pred_tokens", at).alias("norm_pred_token"),
                        F.get("gold_tokens", at).alias("norm_label_token"),
                        F.col("_norm").alias("norm_pred_char"),
                        off.alias("orig_pred_char"),
                        F.get(raw_words, cut).alias("orig_pred_token"),
                        cut.alias("orig_pred_token_index"),
                        F.col("reason"),
                    ),
                ).cast(META_TYPE),
            }
        )
    )
    if steps is None:
        logits = F.array().cast(f"array<{STEP_TYPE}>")
    else:
        if pieces is None:
            raise ValueError("steps need the texts they added: name the pieces column")
        chosen = F.slice(F.col(steps), divergence_step(F.col(pieces), F.col("prefix")) + 1, F.lit(1))
        logits = F.coalesce(chosen, F.array().cast(f"array<{STEP_TYPE}>"))
    out = out.withColumn("logits_top5", logits)
    return out.drop(
        "pred_tokens", "gold_tokens", "div_index", "reason", "_diverged", "_off", "_norm", "_words", "_cut"
    )


def divergence_profile(normalized: DataFrame) -> DataFrame:
    """Rows by reason, predicted token and gold token at the first divergence.

    One shuffle of counted groups: the aggregate is combined before it.
    """
    at = F.col("div_index")
    return (
        token_divergence(normalized)
        .select(
            "reason",
            sqltext.canon(F.get("pred_tokens", at)).alias("pred_token"),
            sqltext.canon(F.get("gold_tokens", at)).alias("gold_token"),
        )
        .groupBy("reason", "pred_token", "gold_token")
        .agg(F.count("*").alias("n_rows"))
    )
