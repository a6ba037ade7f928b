"""Normalised pairs and restored aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.functions import sqltext
from forkline.functions.prompts import strip_reasoning
from forkline.functions.text import text_or_empty


def normalize_pairs(predictions: DataFrame) -> DataFrame:
    """Add normalised texts and alias maps.  One narrow stage, no shuffle."""
    clean = predictions.withColumn("predict", strip_reasoning(text_or_empty(F.col("predict"))))
    label = text_or_empty(F.col("label"))
    return clean.withColumns(
        {
            "normalized_predict": sqltext.remove_aliases(F.col("predict")),
            "normalized_label": sqltext.remove_aliases(label),
            "predict_aliases": sqltext.extract_aliases(F.col("predict")),
            "label_aliases": sqltext.extract_aliases(label),
        }
    )


def alias_restore(divergences: DataFrame) -> DataFrame:
    """Put the aliases of the raw text back into the normalised text.

    Here aliases are taken without the keyword test.
    """

    def restored(side: str):
        aliases = sqltext.extract_aliases(F.col(side), skip_keywords=False)
        return sqltext.restore_aliases(text_or_empty(F.col(f"normalized_{side}")), aliases)

    return divergences.withColumns(
        {f"restored_normalized_{side}": restored(side) for side in ("predict", "label")}
    )
