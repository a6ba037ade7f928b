"""Exact top-k search against brute force: ties, repeats, odd vectors, pruning."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from forkline.llm import topk


def plain(rows, k, every):
    """Rows of (vec_id, vector): the best of every query, sorted."""
    whole = []
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((key, [int(np.floor(64 * float(x))) for x in v]))
    found = []
    for n, (key, q) in enumerate(whole):
        if key % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), other) for m, (other, v) in enumerate(whole) if m != n)
            found += [(key, rank, other, -score) for rank, (score, other) in enumerate(scores[:k], 1)]
    return sorted(found)


def as_rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


SCHEMA = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("block, chunk", [(256, 1 << 14), (3, 2)])
def test_odd_vectors(spark, block, chunk):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(40)]
    rows += [(40, rows[3][1]), (20, rows[20][1]), (20, rows[20][1]), (41, None), (60, [None, 1.0, 0.0, 0.0]), (80, [float("nan")] * 4), (100, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [1.0] * 4), (120, []), (140, [2.0]), (7, [0.5, -0.5, 0.25, 0.0, 9.0, 1.0]), (160, [-0.001] * 6), (-20, [0.0] * 4), (None, None)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for given in (table, table.withColumn("v", F.lit("x")).withColumn("q", F.lit("x")).withColumn("block", F.lit("x"))):
        found = topk.top_k(given, k=5, block=block, chunk=chunk)
        assert as_rows(found) == plain(rows, 5, 20)
    assert topk.top_k(table.limit(0)).count() == 0
    assert topk.top_k(table.filter("vec_id = 20 AND false")).columns == ["query_id", "rank", "vec_id", "score"]


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.5, 0.5]) for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert as_rows(topk.top_k(table, block=16)) == plain(rows, 20, 20)


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (20, [-1.0, 0.5])]
    assert as_rows(topk.top_k(spark.createDataFrame(rows, SCHEMA))) == plain(rows, 20, 20)


def test_wide_values_are_exact(spark):
    rows = [(0, [2.0**24, 1.0]), (1, [2.0**24, 2.0]), (2, [2.0**24, -1.0])]
    assert as_rows(topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))) == plain(rows, 20, 20)


def made_blocks(vectors, size):
    blocks = []
    for n, a in enumerate(range(0, len(vectors), size)):
        cells = vectors[a : a + size]
        width, data = topk._packed(cells)
        kind = topk.WIDTHS[width]
        ends = {"high": cells.max(axis=0).astype(kind).tobytes(), "low": cells.min(axis=0).astype(kind).tobytes()}
        blocks.append(topk.Block({"block": n, "dims": cells.shape[1], "width": width, "ids": np.arange(a, a + len(cells)).astype("<i8").tobytes(), "cells": data, **ends}))
    return blocks


def test_blocks_below_the_limit_are_passed_over():
    """Vectors in tight groups, one group a block: few blocks are scored, and nothing is lost."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (100, 16))
    vectors = np.repeat(centres, 50, axis=0) + rng.integers(-2, 3, (5000, 16))
    blocks = made_blocks(vectors, 50)
    q = np.arange(0, 5000, 20)
    queries = topk.Queries(q, vectors[q], q // 50, q % 50)
    scored = []
    where, ids, scores = topk.search(blocks, queries, np.full(len(q), np.iinfo(np.int64).min), 20, scored)
    assert sum(scored) < 0.25 * len(q) * len(vectors)
    by_query = collections.defaultdict(list)
    for w, i, s in zip(where.tolist(), ids.tolist(), scores.tolist()):
        by_query[w].append((-s, i))
    every = vectors[q] @ vectors.T
    for w, row in enumerate(every):
        assert sorted(by_query[w]) == sorted((-int(s), i) for i, s in enumerate(row) if i != q[w])[:20]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for block in made_blocks(rng.integers(-100, 100, (200, 8)), 7):
        q = rng.integers(-100, 100, 8)
        bound = np.maximum(q, 0) @ block.high.astype(int) + np.minimum(q, 0) @ block.low.astype(int)
        assert (block.cells.astype(int) @ q).max() <= bound


def test_blocks_are_stored_narrow():
    for most, width in ((127, 0), (128, 1), (2**15, 2), (2**31, 3)):
        assert topk._packed(np.array([[most, -1]]))[0] == width
    assert topk._packed(np.array([[-128, 0]]))[0] == 0
