"""Clause lists and the first clause in which two texts differ."""

import re

import pytest
from pyspark.sql import functions as F

from forkline.operators import clauses

PAIRS = "index long, label string, predict string"

RICH = (
    "SELECT T1.a AS x, count(*) c FROM orders AS T1 LEFT JOIN items i ON i.k = T1.k AND i.z != 1 "
    "WHERE T1.c = 'it''s, AND' AND b BETWEEN 1 AND 2 AND (a OR b) GROUP BY T1.a, q "
    "HAVING count(*) > 2 ORDER BY T1.a, x desc LIMIT 3"
)


def sig(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    rows = df.select("i", clauses.signature(F.col("s")).alias("sig")).orderBy("i").collect()
    return [r.sig.asDict() if r.sig else None for r in rows]


def test_all_lists(spark):
    assert sig(spark, RICH)[0] == {
        "tables": ["T1:orders", "T2:items"],
        "joins": ["INNER(T2) ON T2.k = T1.k AND T2.z <> 1"],
        "filters": ["(a OR b)", "T1.c = 'it''s, AND'", "b BETWEEN 1 AND 2"],
        "group_by": ["T1.a", "q"],
        "having": ["COUNT(*) > 2"],
        "select": ["T1.a AS x", "COUNT(*) AS c"],
        "order_by": ["T1.a ASC", "x DESC"],
        "limit": 3,
    }


def test_details(spark):
    got = sig(
        spark,
        "select a.x from b as a, c cross join d where a.x == 1 or y AND z limit 2, 5",
        "SELECT T1.x FROM p AS T2 JOIN q AS T1 ON T2.k = T1.k JOIN db.r ON unknown.k = r.k",
        "SELECT CASE WHEN a AND b THEN 1 ELSE 0 END f FROM t LIMIT x",
        "SELECT DISTINCT t.* FROM t WHERE x AND x LEFT OUTER JOIN u",
    )
    assert got[0]["tables"] == ["T1:b", "T2:c", "T3:d"]
    assert got[0]["joins"] == ["CROSS(T3) ON ", "INNER(T2) ON "]
    # OR binds weaker than AND: no conjuncts
    assert got[0]["filters"] == ["T1.x = 1 OR y AND z"] and got[0]["limit"] == 5
    # swapped alias names are replaced together, not one after another
    assert got[1]["select"] == ["T2.x"]
    assert got[1]["joins"] == ["INNER(T2) ON T1.k = T2.k", "INNER(T3) ON unknown.k = T3.k"]
    assert got[2]["select"] == ["CASE WHEN a AND b THEN 1 ELSE 0 END AS f"] and got[2]["limit"] is None
    assert got[3]["select"] == ["T1.*"] and got[3]["filters"] == ["x"]


def test_not_flat(spark):
    texts = [
        None, "", "garbage", "SELECT a FROM t WHERE x = (SELECT 1)", "SELECT 1 UNION SELECT 2",
        "WITH w AS (SELECT 1) SELECT * FROM w", "SELECT f(a FROM t",
    ]
    assert sig(spark, *texts) == [None] * len(texts)


@pytest.mark.parametrize("long_form", [False, True])
def test_first_difference(spark, long_form):
    cases = [
        ("SELECT a FROM t", "select A FROM t", ("select", "A")),
        ("SELECT a FROM t", "SELECT  a  FROM  t", (None, None)),
        ("SELECT x.a FROM t x", "SELECT y.a FROM t AS y", (None, None)),
        ("SELECT a, b FROM t", "SELECT b, a FROM t", ("select", None)),  # same items, other order
        ("SELECT a FROM t WHERE p AND q", "SELECT a FROM t WHERE q AND p", (None, None)),
        ("SELECT a FROM t LIMIT 5", "SELECT a FROM t", ("limit", "None")),
        ("SELECT a FROM t LIMIT 5", "SELECT a FROM t LIMIT 6", ("limit", "6")),
        ("SELECT a FROM t WHERE p AND q", "SELECT a FROM t WHERE p", ("filters", "p")),
        ("SELECT a FROM t WHERE p", "SELECT a FROM t", ("filters", "filters")),
        ("SELECT a FROM t WHERE p", "SELECT a FROM u WHERE q", ("tables", "T1:u")),
        ("SELECT 1", "nonsense", ("parse_error", None)),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], PAIRS)
    compared = clauses.stage_compare(clauses.clause_table(df)) if long_form else clauses.compare_pairs(df)
    rows = {r["index"]: r for r in compared.collect()}
    got = [(rows[i].first_divergence_stage, rows[i].first_divergence_text) for i in range(len(cases))]
    assert got == [c[2] for c in cases]
    assert [rows[i].is_equivalent for i in range(len(cases))] == [
        None if c[2][0] == "parse_error" else c[2][0] is None for c in cases
    ]


def test_equal_texts_need_no_signature(spark):
    nested = "SELECT a FROM t WHERE a IN (SELECT b FROM u)"
    cases = [(nested, nested.replace(" FROM", "  FROM")), (nested, "SELECT a FROM t"), (nested, nested + " LIMIT 1")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], PAIRS)
    for rows in (clauses.compare_pairs(df), clauses.stage_compare(clauses.clause_table(df))):
        got = {r["index"]: (r.is_equivalent, r.first_divergence_stage) for r in rows.collect()}
        assert got == {0: (True, None), 1: (None, "parse_error"), 2: (None, "parse_error")}


def test_long_limits(spark):
    cases = [("SELECT a FROM t LIMIT 10000000000", "SELECT a FROM t"), ("SELECT a FROM t LIMIT 10000000000", "SELECT a FROM t LIMIT 10000000001")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], PAIRS)
    assert [r.first_divergence_stage for r in clauses.compare_pairs(df).orderBy("index").collect()] == ["limit", "limit"]


def test_a_table_without_a_name_has_no_signature_error(spark):
    df = spark.createDataFrame([(1, "SELECT a FROM WHERE b = 1", "SELECT a FROM t WHERE b = 1")], "index long, label string, predict string")
    row = clauses.compare_pairs(df).first()
    assert row["first_divergence_stage"] == "tables"


def test_white_space_classes_hold_the_same_characters(spark):
    from forkline.functions.text import NON_WS, STRIP_CHARS, WS

    chars = [(chr(n),) for n in (*range(1, 0xD800), *range(0xE000, 0x10000))]
    df = spark.createDataFrame(chars, "c string")
    got = df.filter(F.rlike("c", F.lit(rf"\A{WS}\z"))).collect()
    assert sorted(r["c"] for r in got) == sorted(STRIP_CHARS)
    assert df.filter(F.rlike("c", F.lit(rf"\A{NON_WS}\z"))).count() == len(chars) - len(STRIP_CHARS)


def test_texts_are_split_by_what_stands_on_top_alone(spark):
    got = sig(
        spark,
        "SELECT round(a.x, 2) z, coalesce(f(b, 1), 'x, y') \"o p\" FROM t a WHERE f(p AND q) AND x IN (1, 2)",
        "SELECT CASE WHEN a, b THEN count( * ) END FROM t ORDER BY BYTES, f(a desc) DESC",
        "SELECT t.a WHERE b FROM db.s.t LIMIT 2 OFFSET 3",
        "SELECT a FROM t\x1fWHERE\x0bb\x1c=\n1",
        "select a croß, in (1) from t WHERE lımıt AND 1",
        "SELECT a FROM t WHERE b) AND (c",
        "SELECT a FROM t WHERE f(b",
        "SELECT a, b, 2 AND c FROM t GROUP BY d, 1 OR e",
    )
    assert got[0]["select"] == ["ROUND(T1.x, 2) AS z", "COALESCE(F(b, 1), 'x, y') AS \"o p\""]
    assert got[0]["filters"] == ["F(p AND q)", "x IN (1, 2)"]
    assert got[1]["select"] == ["CASE WHEN a, b THEN COUNT(*) END"]
    assert got[1]["order_by"] == ["BYTES ASC", "F(a DESC) DESC"]
    # clauses out of order, and names with several dots
    assert got[2]["select"] == ["T1.a"] and got[2]["filters"] == ["b"] and got[2]["limit"] == 2
    assert got[2]["tables"] == ["T1:t"]
    # the marks of a text are white space, which never stands in it
    assert got[3]["filters"] == ["b = 1"]
    assert got[4]["select"] == ["a AS croß", "IN (1)"]
    assert got[5]["filters"] == ["b) AND (c"] and got[6] is None
    assert got[7]["select"] == ["a", "b", "2 AND c"] and got[7]["group_by"] == ["1 OR e", "d"]


def test_long_form_takes_one_group_of_each_pair(spark, small):
    from forkline.plans import all_queries

    text = all_queries()["stage_compare_wide"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ObjectHashAggregate\(keys=\[index#\d+L\]", text)) == 2
    assert "stage#" not in "".join(re.findall(r"keys=\[[^\]]*\]", text)) and "Sort" not in text


def test_equal_texts_are_taken_apart_once(spark):
    cases = [("SELECT a FROM t", "SELECT a FROM t"), ("SELECT a FROM t", "SELECT b FROM t"), (None, None), (None, "SELECT a FROM t")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], PAIRS)
    rows = {r["index"]: r for r in clauses.signatures(df).collect()}
    assert [rows[i].gold_signature == rows[i].pred_signature for i in range(4)] == [True, False, True, False]
    assert rows[3].gold_signature is None and rows[3].pred_signature.select == ["a"]
    assert "CASE WHEN (label" in clauses.signatures(df)._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("order", [1, -1])
def test_long_form_compares_lists_in_any_order_of_rows(spark, order):
    rows = [
        (1, "gold", "select", 0, "a"), (1, "gold", "select", 1, "b"), (1, "pred", "select", 0, "a"),
        (2, "gold", "filters", 0, "p"), (2, "pred", "filters", 0, "p"), (2, "pred", "tables", 0, "T1:t"),
        (3, "gold", "having", 0, "x"), (3, "pred", "limit", 0, "5"), (3, "pred", "having", 0, "x"),
        (4, "gold", "tables", 0, None), (4, "pred", "tables", 0, None),
        (5, "gold", "joins", 0, "j"), (5, "pred", "having", 0, "h"),
    ]
    df = spark.createDataFrame(rows[::order], "index long, side string, stage string, pos int, item string")
    got = {r["index"]: tuple(r)[1:] for r in clauses.stage_compare(df).collect()}
    assert got == {
        1: (False, "select", "a"), 2: (False, "tables", "T1:t"), 3: (False, "limit", "5"), 4: (True, None, None),
        5: (False, "joins", "joins"),
    }
