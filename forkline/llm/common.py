"""Helpers of the corpus operators: tables in the shared folder, words, bound expressions."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.session import scratch_root

#: Runs of ASCII white space, the complement of the word class ``[^\x20\x09-\x0D]``.
BLANK_RUNS = r"[\x20\x09-\x0D]+"


def keep_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, computes costly rows once, and lets Spark plan what follows
    by the real size (a join against it is broadcast only under Spark's own limit).
    """
    path = f"{scratch_root(spark).rstrip('/')}/forkline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bind(column: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body uses it."""
    return F.transform(F.array(column), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def blank_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUNS), "")


def windows(items: Column, size: int) -> Column:
    """64-bit hashes of the windows of ``size`` items, by position; none where there are fewer."""
    starts = F.sequence(F.lit(0), F.size(items) - size)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(items, i + k) for k in range(size)]))
    return F.when(F.size(items) >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """All columns as one struct ``row`` beside the given ones, so that no names can clash."""
    return df.select(F.struct("*").alias("row"), *columns)
