"""Divergence: edges, steps, and independence of partitioning."""

import random

from pyspark.sql import functions as F

from forkline.operators.diverge import clean_marker, diverge, divergence_step, token_divergence
from forkline.operators.normalize import normalize_pairs
from forkline.plans import fixtures as fx


def diverged(spark, pairs):
    rows = [(i, "p", p, g) for i, (p, g) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "index long, prompt string, predict string, label string")
    return diverge(normalize_pairs(df)).orderBy("index").collect()


def test_edges(spark):
    rows = diverged(
        spark,
        [
            ("SELECT a FROM t", "SELECT a FROM t WHERE b"),
            ("SELECT a FROM t  WHERE b", "SELECT a FROM t"),
            ("<think>no</think>SELECT A", "select a"),
            (None, "SELECT 1"),
            ("", None),
            ("SELECT a,\nb FROM t", "SELECT a, c FROM t"),
        ],
    )
    # a strict prefix of gold counts as no divergence
    assert (rows[0].prefix, rows[0].suffix, rows[0].divergence_meta) == ("SELECT a FROM t", "", None)
    meta = rows[1].divergence_meta
    assert (rows[1].prefix, rows[1].suffix) == ("SELECT a FROM t", "WHERE b")
    assert (meta.reason, meta.norm_pred_token, meta.norm_label_token) == ("length_mismatch", "WHERE", None)
    assert (meta.norm_pred_char, meta.orig_pred_char, meta.orig_pred_token_index) == (16, 17, 4)
    assert (rows[2].predict, rows[2].divergence_meta) == ("SELECT A", None)
    assert (rows[3].prefix, rows[3].suffix) == ("", "")
    assert rows[4].divergence_meta is None
    assert (rows[5].prefix, rows[5].suffix) == ("SELECT a,", "b FROM t")
    assert all(r.logits_top5 == [] and r.semantic_divergence is None for r in rows)


def test_known_offsets(spark):
    """Raw offset, word index and first word of the four ways the pair fixture diverges."""
    label = "SELECT T1.o_orderstatus FROM orders AS T1 WHERE T1.o_custkey = 899"
    cases = [
        (label.replace("o_orderstatus", "o_totalprice"), 7, 1, "T1.o_totalprice"),
        (label + " ORDER BY T1.o_totalprice", 67, 10, "ORDER"),
        (label.replace("899", "900"), 63, 9, "900"),
        (label.split(" WHERE")[0] + " GROUP BY T1.o_orderstatus", 42, 6, "GROUP"),
    ]
    rows = diverged(spark, [(c[0], label) for c in cases])
    got = [
        (r.predict, r.divergence_meta.orig_pred_char, r.divergence_meta.orig_pred_token_index, r.suffix.split()[0])
        for r in rows
    ]
    assert got == cases
    assert rows[1].prefix == label


def test_reasons(spark):
    df = spark.createDataFrame(
        [("a b", "a b"), ("a 'B'", "a 'b'"), ("A b c", "a b"), ("x", "")],
        "normalized_predict string, normalized_label string",
    )
    got = [(r.div_index, r.reason) for r in token_divergence(df).collect()]
    assert got == [(-1, "identical"), (1, "token_mismatch"), (2, "length_mismatch"), (0, "length_mismatch")]


def brute_step(pieces, prefix):
    wanted = " ".join(prefix.split())
    if not pieces or not wanted:
        return 0
    so_far = [" ".join("".join(pieces[: k + 1]).split()) for k in range(len(pieces))]
    holding = [k for k, t in enumerate(so_far) if wanted in t]
    last = None
    for k in holding:
        if not so_far[k].endswith(wanted):
            break
        last = k + 1
    return len(pieces) - 1 if last is None else min(last, len(pieces) - 1)


def test_divergence_step(spark):
    cases = [
        ([" SELECT", " a", " FROM", ""], "SELECT a"),
        (["a", "a", "a"], "a"),
        (["think", " SELECT", " x", " SELECT"], "SELECT"),
        (["SELECT a", " ", "\n", "b"], "SELECT a"),
        (["x"], "y"),
        ([], "y"),
        (["a"], " "),
        (["SEL", "ECT", " a"], "SELECT"),
    ]
    rng = random.Random(3)
    for _ in range(150):
        pieces = [rng.choice(["a", " a", "b", " ", "", "ab", " b a", "\n"]) for _ in range(rng.randrange(1, 9))]
        cases.append((pieces, rng.choice(["a", "a b", "ab", "b a", "a  a", "b"])))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, g array<string>, p string")
    got = df.select("i", divergence_step(F.col("g"), F.col("p")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [brute_step(*c) for c in cases]


def test_marker(spark):
    df = spark.createDataFrame([("Ġab",), ("aĠ",), (None,)], "t string")
    assert [r[0] for r in df.select(clean_marker(F.col("t"))).collect()] == ["ab", "a", ""]


def test_same_rows_for_any_partitioning(spark, small):
    pairs = fx.sql_pairs(spark, small).select("index", "prompt", "predict", "label")
    seen = {
        n: sorted(
            map(str, diverge(normalize_pairs(pairs.repartition(n))).select("index", "prefix", "suffix").collect())
        )
        for n in (1, 4, 17)
    }
    assert seen[1] == seen[4] == seen[17]


def test_normalising_twice_changes_nothing(spark, small):
    once = normalize_pairs(fx.sql_pairs(spark, small)).select("index", F.col("normalized_predict").alias("predict"), "label")
    twice = normalize_pairs(once)
    assert twice.filter(F.col("predict") != F.col("normalized_predict")).count() == 0
