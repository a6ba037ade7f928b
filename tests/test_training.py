"""Sampling, pairs, masks, batches, losses, scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from forkline.operators import losses, masks, sampling, scores


def ids(spark, n, parts=4):
    return spark.range(n).select(F.col("id").alias("index")).repartition(parts)


def test_rank_is_dense_and_independent_of_partitions(spark):
    seen = {}
    for parts in (1, 4, 17):
        rows = sampling.seeded_rank(ids(spark, 1000, parts), "index", 7).collect()
        assert sorted(r["rank"] for r in rows) == list(range(1000))
        seen[parts] = {r["index"]: r["rank"] for r in rows}
    assert seen[1] == seen[4] == seen[17]
    # a coarser or finer set of buckets changes nothing
    coarse = sampling.seeded_rank(ids(spark, 1000), "index", 7, bucket_rows=100).collect()
    assert {r["index"]: r["rank"] for r in coarse} == seen[1]
    top = sampling.seeded_rank(ids(spark, 1000), "index", 7, upto=50).collect()
    assert {r["index"]: r["rank"] for r in top} == {k: v for k, v in seen[1].items() if v < 50}


def test_sample_needs_enough_rows(spark):
    df = spark.createDataFrame([(str(i), m) for i in range(20) for m in "ab"], "id string, mode string")
    rows = sampling.sample_items(df, 7).collect()
    assert len(rows) == 14 and len({r.id for r in rows}) == 7
    with pytest.raises(Exception, match="fewer rows"):
        sampling.sample_items(df, 21).collect()


def outcomes(spark, failed, passed, unknown=5):
    flags = [False] * failed + [True] * passed + [None] * unknown
    rows = [(i, "q", f"p{i}", f"l{i}", f, None) for i, f in enumerate(flags)]
    return spark.createDataFrame(
        rows, "index long, prompt string, predict string, label string, exec_match boolean, error string"
    )


@pytest.mark.parametrize(
    ("failed", "passed", "forget", "retain", "expected"),
    [
        (30, 50, 10, 20, (10, 20, 0)),
        (30, 5, 10, 12, (10, 5, 7)),
        (12, 5, 10, 12, (10, 5, 2)),
        (4, 0, 10, 3, (4, 0, 0)),
        (0, 6, 3, 10, (0, 6, 0)),
    ],
)
def test_split_sizes(spark, failed, passed, forget, retain, expected):
    data = outcomes(spark, failed, passed)
    rows = sampling.split_sets(data, forget, retain, bucket_rows=100).collect()
    kinds = [(r["set"], r.answer_source) for r in rows]
    assert (
        kinds.count(("forget", "predict")),
        kinds.count(("retain", "predict")),
        kinds.count(("retain", "label")),
    ) == expected
    assert len({r.id for r in rows}) == len(rows)
    for r in rows:
        assert r.answer == ("l" if r.answer_source == "label" else "p") + r.id
        assert r.original_exec_match is (int(r.id) >= failed)


def test_pairs_change_with_the_epoch(spark):
    forget = spark.createDataFrame([(str(i), "f") for i in range(300)], "id string, answer string")
    retain = spark.createDataFrame([(f"r{i}", "r") for i in range(40)], "id string, answer string")

    def drawn(anchor, epoch):
        rows = sampling.pair_sets(forget, retain, anchor, epoch=epoch).collect()
        return {r[anchor].id: r["retain" if anchor == "forget" else "forget"].id for r in rows}

    first = drawn("forget", 0)
    assert len(first) == 300 and first == drawn("forget", 0) and first != drawn("forget", 1)
    assert len(set(first.values())) > 30
    assert len(drawn("retain", 0)) == 40
    with pytest.raises(ValueError):
        sampling.pair_sets(forget, retain, "other")


SAMPLE = (
    "index long, input_ids array<int>, token_texts array<string>, answer string, answer_tokens array<string>, "
    "forget_tail string, forget_part string, forget_mode string"
)


def test_forget_masks(spark):
    texts = ["q", "<h1>", "<h2>", "\n\n", "SELECT", " a", " FROM", " t", "<eot>"]
    answer, parts = "SELECT a FROM t", ["SELECT", " a", " FROM", " t"]
    base = ([9, 1, 2, 3, 4, 5, 6, 7, 8], texts, answer, parts)
    bare = ([9, 3, 4], ["q", "\n", "x"], answer, parts)
    cases = [
        (base, (None, None, "First"), [0, 0, 0, 1, 1, 1, 1, 1, 1]),
        (base, (" FROM t", None, "First"), [0, 0, 0, 0, 0, 0, 1, 0, 0]),
        (base, (" FROM t", None, "Whole"), [0, 0, 0, 0, 0, 0, 1, 1, 0]),
        (base, (" FROM t", " FROM", "Whole"), [0, 0, 0, 0, 0, 0, 1, 0, 0]),
        (base, (" FROM t", None, "Odd"), [0, 0, 0, 0, 0, 0, 1, 0, 0]),
        (base, (" FROM t", None, None), [0, 0, 0, 0, 0, 0, 1, 0, 0]),
        # a tail that starts inside a token: the token before it still counts
        (base, ("FROM t", None, "First"), [0, 0, 0, 0, 0, 0, 0, 1, 0]),
        (base, ("nowhere", None, "First"), [0, 0, 0, 0, 1, 1, 1, 1, 1]),
        (base, ("SELECT", None, "First"), [0, 0, 0, 0, 1, 1, 1, 1, 1]),
        (base, ("<|eot_id|>", None, "First"), [0, 0, 0, 0, 1, 1, 1, 1, 1]),
        (base, ("", None, "First"), [0, 0, 0, 0, 1, 0, 0, 0, 0]),
        # no header: nothing is an answer
        (bare, (None, None, "First"), [0, 0, 0]),
    ]
    rows = [(i, *c[0], *c[1]) for i, c in enumerate(cases)]
    repeated = ([1, 2, 4, 4], ["<h1>", "<h2>", "a", " a"], "a a", ["a", " a"], "a", None, "First")
    rows.append((len(rows), *repeated))
    got = masks.encode_samples(spark.createDataFrame(rows, SAMPLE), [1, 2]).orderBy("index").collect()
    assert [r.forget_mask for r in got[:-1]] == [c[2] for c in cases]
    # the first occurrence of a repeated tail is marked
    assert got[-1].forget_mask == [0, 0, 1, 0]
    assert got[0].labels == [-100, -100, -100, 3, 4, 5, 6, 7, 8]
    assert got[11].labels == [9, 3, 4]
    short = masks.encode_samples(spark.createDataFrame(rows[:1], SAMPLE), [1, 2], max_length=2).first()
    assert (short.input_ids, short.labels, short.forget_mask) == ([9, 1], [9, 1], [0, 0])


def test_padding(spark):
    rows = [(i, list(range(n)), [1] * n, [5] * n, [1] * n) for i, n in enumerate([2, 4, 1, 3, 0])]
    df = spark.createDataFrame(
        rows,
        "index long, input_ids array<int>, attention_mask array<int>, labels array<int>, forget_mask array<int>",
    )
    got = masks.batch_pad(df, 2, 99).orderBy("index").collect()
    assert [r.batch_id for r in got] == [0, 0, 1, 1, 2]
    assert [len(r.input_ids) for r in got] == [4, 4, 3, 3, 0]
    assert (got[0].input_ids, got[0].labels) == ([0, 1, 99, 99], [5, 5, -100, -100])
    assert (got[2].attention_mask, got[2].forget_mask) == ([1, 0, 0], [1, 0, 0])


LOSS = "batch_id long, side string, sample_id long, pos long, label_id long, forget_mask int, nll double, ref_nll double"


def test_losses_by_hand(spark):
    rng = random.Random(11)
    rows = []
    for sample in range(24):
        side = "forget" if sample % 3 else "retain"
        for pos in range(rng.randrange(1, 8)):
            label = -100 if rng.random() < 0.3 else 5
            rows.append((sample // 6, side, sample, pos, label, rng.randrange(2), rng.random() * 9, rng.random() * 9))
    rows.append((99, "forget", 1000, 1, 5, 1, 0.0, 1.0e5))  # an extreme ratio stays finite
    got = {r.batch_id: r for r in losses.unlearn_loss(spark.createDataFrame(rows, LOSS), 0.1, 2.0, 3.0).collect()}
    assert got[99].forget_loss == pytest.approx(20 * 0.1 * 1.0e5) and got[99].retain_loss is None
    for batch in range(4):
        mine = [r for r in rows if r[0] == batch and r[3] > 0 and r[4] != -100]
        terms = []
        for sample in {r[2] for r in rows if r[0] == batch and r[1] == "forget"}:
            ratio = sum((r[7] - r[6]) * r[5] for r in mine if r[2] == sample)
            terms.append(2 / 0.1 * math.log1p(math.exp(0.1 * ratio)))
        kept = [r[6] for r in mine if r[1] == "retain"]
        forget, retain = sum(terms) / len(terms), sum(kept) / len(kept)
        assert got[batch].forget_loss == pytest.approx(forget)
        assert got[batch].retain_loss == pytest.approx(retain)
        assert got[batch].total_loss == pytest.approx(3 * forget + 2 * retain)


def test_topk_against_brute_force(spark):
    rng = random.Random(2)
    steps = {s: [rng.gauss(0, 400) for _ in range(40)] for s in range(6)}
    steps[6] = [5.0] * 8  # ties go to the smaller id
    steps[7] = [float("-inf"), 1.0, float("-inf"), -2000.0]
    rows = [(s, t, x) for s, xs in steps.items() for t, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "step_id long, token_id long, score double")
    got = scores.step_topk(df, 3).orderBy("step_id", "rank").collect()
    for s, xs in steps.items():
        top = max(xs)
        weights = [math.exp(x - top) for x in xs]
        order = sorted(range(len(xs)), key=lambda t: (-xs[t], t))[:3]
        mine = [r for r in got if r.step_id == s]
        assert [r.token_id for r in mine] == order
        for r in mine:
            assert r.prob == pytest.approx(weights[r.token_id] / sum(weights), abs=1e-12)


def test_mean_pool_and_cosine(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [100.0, 100.0], 0), ("b", [0.0, 0.0], 1)],
        "id string, embedding array<double>, mask int",
    )
    pooled = scores.mean_pool(df)
    assert {r.id: r.embedding for r in pooled.collect()} == {"a": [2.0, 4.0], "b": [0.0, 0.0]}
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "a string, b string")
    got = {(r.a, r.b): r.similarity for r in scores.cosine_pairs(pairs, pooled).collect()}
    assert got[("a", "a")] == pytest.approx(1.0) and got[("a", "b")] is None


def test_sample_of_an_empty_table_fails(spark):
    with pytest.raises(Exception, match="fewer rows"):
        sampling.sample_items(ids(spark, 0).withColumnRenamed("index", "id"), 5).collect()
    with pytest.raises(Exception, match="fewer rows"):
        sampling.sample_items(ids(spark, 4).withColumnRenamed("index", "id"), 5).collect()
    assert sampling.sample_items(ids(spark, 5).withColumnRenamed("index", "id"), 5).count() == 5


def test_pairing_with_an_empty_set_fails(spark):
    some, none = (ids(spark, n).withColumnRenamed("index", "id") for n in (3, 0))
    with pytest.raises(Exception, match="no retain row"):
        sampling.pair_sets(some, none).collect()
    assert sampling.pair_sets(none, some).count() == 0


def test_bucket_size_changes_no_rank(spark):
    few = sampling.seeded_rank(ids(spark, 500), "index", 7, bucket_rows=10).collect()
    one = sampling.seeded_rank(ids(spark, 500), "index", 7).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, one))


def test_blank_run_and_long_rows(spark):
    """A long blank run after the header, no cut by default, and rows over an asked-for cut."""
    texts = ["<h>"] + [" "] * 25 + ["yes", " no"]
    sample = [(0, [9] + [1] * 27, texts, "yes no", ["yes", " no"], " no", None, "First")]
    kind = "index long, input_ids array<int>, token_texts array<string>, answer string, answer_tokens array<string>, forget_tail string, forget_part string, forget_mode string"
    row = masks.encode_samples(spark.createDataFrame(sample, kind), [9]).first()
    assert row.forget_mask == [0] * 27 + [1]
    long = spark.range(3).selectExpr("id AS index", "sequence(1, cast(4000 + id as int)) AS input_ids")
    arrays = {c: F.col("input_ids") for c in ("attention_mask", "labels", "forget_mask")}
    padded = masks.batch_pad(long.withColumns(arrays), batch_size=2, pad_id=0).collect()
    assert sorted(len(r.input_ids) for r in padded) == [4001, 4001, 4002]
    cut = masks.batch_pad(long.withColumns(arrays), batch_size=2, pad_id=0, max_length=10).collect()
    assert {len(r[c]) for r in cut for c in ("input_ids", "attention_mask", "labels", "forget_mask")} == {10}
