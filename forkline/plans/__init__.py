"""Registered queries, their input tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forkline.plans import eval_queries, io_queries, text_queries, training_queries  # noqa: F401
from forkline.plans.registry import ORACLES, QUERIES


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
