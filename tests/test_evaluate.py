"""Result comparison, outcomes, joins and error classes."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from forkline.functions.values import number_value, text_value
from forkline.operators import classify as cl
from forkline.operators import evaluate as ev
from forkline.operators import items as it

ROWS = "index long, side string, vals array<string>"
STATUS = "index long, pred_error string, gold_error string, pred_parse_error string, gold_parse_error string"


def test_result_multisets(spark):
    rows = [
        (1, "pred", ["a", "b"]), (1, "gold", ["b", "a"]),  # column order counts
        (2, "pred", ["a"]), (2, "pred", ["b"]), (2, "gold", ["b"]), (2, "gold", ["a"]),  # row order does not
        (3, "pred", ["a"]), (3, "pred", ["a"]), (3, "gold", ["a"]),  # repeats count
        (4, "pred", [None, "x"]), (4, "gold", [None, "x"]),  # null equals null
        (5, "pred", ["a"]),  # rows against none
        (7, "pred", ["a"]), (7, "gold", ["a"]),  # equal rows, but a failed run
    ]
    status = [(i, None, None, None, None) for i in range(1, 7)] + [(7, None, "boom", None, None)]
    got = ev.exec_match(spark.createDataFrame(rows, ROWS), spark.createDataFrame(status, STATUS))
    assert {r["index"]: (r.exec_match, r.error) for r in got.collect()} == {
        1: (False, "results differ"),
        2: (True, None),
        3: (False, "results differ"),
        4: (True, None),
        5: (False, "results differ"),
        6: (True, None),  # empty equals empty
        7: (False, "boom"),
    }


def test_values(spark):
    df = spark.sql(
        "SELECT number_a, text_a FROM VALUES (1.0D, '1'), (1.5D, '1.5'), (1e300D, 'x'), (-0.0D, ''), (NULL, NULL) AS t(number_a, text_a)"
    )
    got = df.select(number_value(F.col("number_a")), text_value(F.col("text_a"))).collect()
    assert [tuple(r) for r in got] == [("n1", "s1"), ("n1.5", "s1.5"), ("n1.0E300", "sx"), ("n0", "s"), (None, None)]
    ints = spark.sql("SELECT 9007199254740993L AS a, 9007199254740992L AS b")
    assert ints.select(number_value(F.col("a")) != number_value(F.col("b"))).first()[0]


def test_outcome_counters(spark):
    looked = spark.createDataFrame(
        [(1, "d", None), (2, None, "no database id"), (3, "d", None), (4, "d", None), (5, "d", None)],
        "index long, db_id string, lookup_error string",
    )
    status = spark.createDataFrame(
        [(1, None, None, None, None), (2, None, None, None, None), (3, None, None, "bad pred", None), (4, None, None, None, "bad gold")],
        STATUS,
    )
    out = ev.evaluate_runs(looked, spark.createDataFrame([], ROWS), status)
    rows = {r["index"]: (r.exec_match, r.error) for r in out.collect()}
    # a prediction that cannot be parsed may still match, and keeps its error
    assert rows == {
        1: (True, None),
        2: (False, "no database id"),
        3: (True, "bad pred"),
        4: (False, "bad gold"),
        5: (False, "not run"),
    }
    assert tuple(ev.accuracy(out).first()) == (5, 2, 40.0, 1, 2, 1)
    assert ev.accuracy(out.limit(0)).first().accuracy_pct is None


def test_integrity_failures(spark):
    ex = spark.createDataFrame([(1, "g", "d", False)], "index long, gold_sql string, db_id string, exec_match boolean")
    div = spark.createDataFrame([(1, "other")], "index long, label string")
    with pytest.raises(Exception, match="gold text and label differ"):
        ev.join_divergences(ex, div).collect()
    with pytest.raises(Exception, match="differ in length"):
        ev.align_gold(
            spark.createDataFrame([(1, "g"), (2, "g")], "index long, gold string"),
            spark.createDataFrame([(1, "p")], "index long, predict string"),
        ).collect()


def test_unknown_outcomes(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "index long, exec_match boolean")
    picked = [ev.failed_rows, ev.strictly_failed, ev.strictly_passed]
    assert [sorted(r["index"] for r in f(df).collect()) for f in picked] == [[2, 3], [2], [1]]


def test_remainder_and_boundary(spark):
    cases = [
        ("SELECT a FROM t", "SELECT a", "FROM", "FROM t", True),
        ("SELECT  a FROM t", "SELECT a", "FROM", "FROM t", True),  # by words
        ("SELECT a", "SELECT a", "<|eot_id|>", "<|eot_id|>", True),
        ("SELECT a", "SELECT a b c", "x", "<|eot_id|>", False),
        ("user_id x", "", "user", "user_id x", True),  # underscore is a boundary
        ("users x", "", "user", "users x", False),
        ("user", "", "", "user", False),
        ("(é)", "(", "é", "é)", True),
        ("éa", "", "é", "éa", False),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, label string, prefix string, cand string")
    rest = cl.gold_remainder(F.col("label"), F.col("prefix"))
    got = df.select("i", rest.alias("r"), cl.boundary_match(rest, F.col("cand")).alias("m")).orderBy("i").collect()
    assert [(r.r, r.m) for r in got] == [c[3:] for c in cases]


FAILED = (
    "index long, label string, prefix string, suffix string, "
    "logits_top5 array<struct<generated_token: string, top5_tokens: array<string>>>"
)


def test_classes(spark):
    rows = [
        (1, "SELECT a FROM t", "SELECT a", "WHERE x", [("WHERE", ["WHERE", "near"])]),  # 1 and 2
        (2, "SELECT a FROM t", "SELECT a", "where x", [("far", ["FROM"])]),  # lower case: 3 only
        (3, "SELECT a FROM t", "SELECT a", "x", [("FROM", ["FROM"])]),  # its own token: none
        (4, "SELECT a FROM t", "SELECT a", "x", []),  # no candidates: 2
        (5, "SELECT a", "SELECT a", "", [("z", ["<|eot_id|>"])]),  # ends; no vector for z
        (6, "SELECT a FROM t", "SELECT a", "GROUP BY", [("far", ["FROM", "FROM t"])]),  # 1 and 3
        (7, "SELECT a FROM t", "SELECT a", "x", None),
    ]
    vectors = spark.createDataFrame(
        [("FROM", [1.0, 0.0]), ("far", [0.0, 1.0]), ("FROM t", [0.0, 0.0]), ("<|eot_id|>", [1.0, 1.0])],
        "token string, embedding array<double>",
    )
    flags = cl.class_flags(spark.createDataFrame(rows, FAILED), vectors)
    assert {r["index"]: (r.suffix, r.classes) for r in flags.collect()} == {
        1: ("WHERE x", [1, 2]),
        2: ("where x", [3]),
        3: ("x", []),
        4: ("x", [2]),
        5: ("<|eot_id|>", []),
        6: ("GROUP BY", [1, 3]),
        7: ("x", [2]),
    }


def test_leading_part(spark):
    df = spark.createDataFrame([(" WHERE x",), ("  ",), ("",)], "t string")
    got = [r[0] for r in df.select(it.leading_part(F.col("t"), "<|eot_id|>")).collect()]
    assert got == ["WHERE", " ", "<|eot_id|>"]


def test_fingerprints_equal_multisets(spark):
    """Random small results, many of them equal up to order, nulls and empty texts included."""
    import collections
    import random

    rng = random.Random(3)
    rows, expected = [], {}
    values = [None, "", "a", "=", "b", "ab"]
    for index in range(600):
        pred = [rng.choices(values, k=rng.randint(0, 2)) if rng.random() < 0.95 else None for _ in range(rng.randint(0, 3))]
        gold = rng.sample(pred, len(pred))
        if rng.random() < 0.6:
            gold = [rng.choices(values, k=len(v)) if v and rng.random() < 0.5 else v for v in gold][: rng.choice([None, -1])]
        rows += [(index, side, v) for side, side_rows in (("pred", pred), ("gold", gold)) for v in side_rows]
        if pred or gold:
            count = lambda r: collections.Counter(None if v is None else tuple(v) for v in r)
            expected[index] = (count(pred), count(gold))
    table = spark.createDataFrame(rows, "index long, side string, vals array<string>").repartition(5)
    found = {r["index"]: r.same_rows for r in ev.compare_results(table).collect()}
    assert found == {i: p == g for i, (p, g) in expected.items()}
    assert set(found.values()) == {True, False}
    surplus = sorted(str((r["index"], r.side, None if r.vals is None else tuple(r.vals), r.n_rows)) for r in ev.surplus_rows(table).collect())
    by_hand = [(i, side, v, n) for i, (p, g) in expected.items() for side, rest in (("pred", p - g), ("gold", g - p)) for v, n in rest.items()]
    assert surplus == sorted(map(str, by_hand))


def test_surplus_is_counted_in_partitions_by_rows(spark, monkeypatch):
    """More rows make more partitions, not larger ones, and nothing is held before rows move."""
    assert [ev.counting_partitions(n) for n in (0, 1, 250_001, 72_000_000, 432_000_000)] == [1, 1, 2, 200, 216]
    monkeypatch.setattr(ev, "COUNTED_ROWS", 100)
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("index"),
        F.when(F.col("id") % 2 == 0, "pred").otherwise("gold").alias("side"),
        F.when(F.col("id") % 7 > 0, F.array((F.col("id") % 5).cast("string"), F.lit(None))).alias("vals"),
    )
    text = ev.surplus_rows(rows)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text and "Join" not in text
    assert re.search(r"Exchange hashpartitioning\(index#\d+L, vals#\d+, 30\)", text)
    counts = collections.Counter()
    for r in rows.collect():
        counts[r["index"], None if r.vals is None else tuple(r.vals)] += 1 if r.side == "pred" else -1
    found = {(r["index"], None if r.vals is None else tuple(r.vals)): (r.side, r.n_rows) for r in ev.surplus_rows(rows).collect()}
    assert found == {k: ("pred" if n > 0 else "gold", abs(n)) for k, n in counts.items() if n}
