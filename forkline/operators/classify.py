"""Error classes of failed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.functions.sqltext import SQL_KEYWORDS
from forkline.functions.text import first_word, let, strip, text_or_empty, words
from forkline.functions.vectors import cosine
from forkline.operators.evaluate import failed_rows, join_divergences
from forkline.schemas import END_OF_TURN
from forkline.sources.tables import stored


def gold_remainder(label: Column, prefix: Column) -> Column:
    """What gold goes on with after the prefix; an empty remainder is the end mark.

    A label that does not start with the prefix drops as many words as the prefix has.
    """
    rest = strip(label.substr(F.length(prefix) + 1, F.length(label)))
    gold_words = words(label)
    by_words = F.array_join(
        F.slice(gold_words, F.size(words(prefix)) + 1, F.greatest(F.size(gold_words), F.lit(1))), " "
    )
    found = F.when(F.startswith(label, prefix), rest).otherwise(by_words)
    return let(found, lambda t: F.when(t == "", F.lit(END_OF_TURN)).otherwise(t))


def boundary_match(remainder: Column, candidate: Column) -> Column:
    """The candidate starts the remainder, and the next character is no letter or digit."""
    after = remainder.substr(F.length(candidate) + 1, F.lit(1))
    return (
        (candidate != "")
        & F.startswith(remainder, candidate)
        & ~F.rlike(after, F.lit(r"[\p{L}\p{N}]"))
    )


def starts_with_keyword(suffix: Column) -> Column:
    """Case matters: ``where`` is not in the list."""
    return F.coalesce(first_word(suffix).isin(*SQL_KEYWORDS), F.lit(False))


def with_features(failed: DataFrame) -> DataFrame:
    """Add ``starts_clause``, ``generated``, ``remainder`` and ``matches``; an empty
    suffix becomes the end mark.  Narrow."""
    top = F.get("logits_top5", F.lit(0))
    suffix = text_or_empty(F.col("suffix"))
    candidates = F.coalesce(top["top5_tokens"], F.array().cast("array<string>"))
    matching = F.filter(
        F.transform(candidates, lambda t: strip(text_or_empty(t))),
        lambda t: boundary_match(F.col("remainder"), t),
    )
    return failed.withColumns(
        {
            "suffix": F.when(first_word(suffix).isNull(), F.lit(END_OF_TURN)).otherwise(suffix),
            "starts_clause": starts_with_keyword(suffix),
            "generated": strip(text_or_empty(top["generated_token"])),
            "remainder": gold_remainder(text_or_empty(F.col("label")), text_or_empty(F.col("prefix"))),
        }
    ).withColumn("matches", matching)


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine per distinct ``a, b`` token pair; each vector is joined once per pair.

    Pairs are made distinct before any vector is attached, so a pair that millions of
    rows share costs one comparison.
    """
    left = vectors.select(F.col("token").alias("a"), F.col("embedding").alias("_va"))
    right = vectors.select(F.col("token").alias("b"), F.col("embedding").alias("_vb"))
    return (
        pairs.select("a", "b")
        .distinct()
        .join(left, "a")
        .join(right, "b")
        .select("a", "b", cosine(F.col("_va"), F.col("_vb")).alias("similarity"))
    )


def unlike_rows(features: DataFrame, vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``index`` of the rows with a matching candidate unlike the generated token.

    Only (index, candidate, generated token) of matching candidates move.  A candidate that
    is the generated token has similarity one and is dropped before the shuffle unless the
    threshold lies above that.  Pairs are made distinct before vectors are attached, and
    the few unlike pairs meet the rows in one plain equi join, in which adaptive execution
    splits a pair that much of the table shares.
    """
    # explode_outer, then a filter: for a plain explode the optimizer copies the whole
    # expression of the candidates into a filter below every projection.
    matched = features.select(
        "index", F.explode_outer("matches").alias("a"), F.col("generated").alias("b")
    ).filter(F.col("a").isNotNull())
    if threshold <= 1:
        matched = matched.filter(F.col("a") != F.col("b"))
    unlike = pair_similarity(matched, vectors).filter(F.col("similarity") < threshold).select("a", "b")
    return matched.join(unlike, ["a", "b"], "left_semi").select("index").distinct()


def _with_classes(features: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    unlike = unlike_rows(features, vectors, threshold).withColumn("_unlike", F.lit(True))
    flags = (
        F.col("starts_clause"),
        F.size("matches") == 0,
        F.coalesce(F.col("_unlike"), F.lit(False)),
    )
    numbered = F.array(*[F.when(flag, F.lit(n)) for n, flag in enumerate(flags, 1)])
    return (
        features.join(unlike, "index", "left")
        .withColumn("classes", F.array_compact(numbered))
        .drop("_unlike", "starts_clause", "generated", "remainder", "matches")
    )


def class_flags(failed: DataFrame, vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``index, suffix, classes``: 1 next word is a clause word, 2 no candidate goes on
    as gold does, 3 a candidate does but is unlike the token that was generated.

    A row without candidates is class 2.
    """
    features = with_features(failed).select(
        "index", "suffix", "starts_clause", "generated", "remainder", "matches"
    )
    return _with_classes(stored(features, "features"), vectors, threshold)


def classify(
    exec_results: DataFrame, divergences: DataFrame, vectors: DataFrame, threshold: float = 0.8
) -> DataFrame:
    """Failed divergence rows with ``classes``; rows of no class have an empty list.

    The rows with their features are stored, so that the text work is done once for the
    three uses of them.
    """
    failed = failed_rows(join_divergences(exec_results, divergences))
    return _with_classes(stored(with_features(failed), "features"), vectors, threshold)


def in_any_class(classified: DataFrame) -> DataFrame:
    """The distinct union of the classes: each row once, in one pass."""
    return classified.filter(F.size("classes") > 0)


def class_sizes(classified: DataFrame) -> DataFrame:
    """Rows per class, and of the union under class 0."""
    groups = F.when(F.size("classes") > 0, F.concat(F.array(F.lit(0)), F.col("classes")))
    return (
        classified.select(F.explode(groups).alias("error_class"))
        .groupBy("error_class")
        .agg(F.count("*").alias("n_rows"))
    )
