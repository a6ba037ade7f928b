"""Texts, aliases, tokens: hand-worked cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from forkline.functions import prompts, sqltext, text


def evaluate(spark, values, *columns):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def one(spark, values, column):
    return [r[0] for r in evaluate(spark, [(v, None) for v in values], column)]


def test_spaces(spark):
    values = ["a\r\n b\t\tc ", None, "", " x\xa0y\x1f", "  "]
    assert one(spark, values, text.collapse_spaces(F.col("a"))) == ["a b c", "", "", "x y", ""]
    assert one(spark, ["　 x y\x1c"], text.strip(F.col("a"))) == ["x y"]
    assert one(spark, [" ab  c\n"], text.words(F.col("a"))) == [["ab", "c"]]


def test_words_before(spark):
    got = evaluate(
        spark,
        [("ab cd  ef", str(n)) for n in (0, 1, 2, 3, 4, 6, 7, 8, 9)],
        text.words_before(F.col("a"), F.col("b").cast("int")),
    )
    assert [r[0] for r in got] == [0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_character_divergence(spark):
    cases = [("abc", "abd", 2), ("abc", "abc", -1), ("ab", "abcd", 2), ("", "a", 0), ("é😀x", "é😀y", 2)]
    rng = random.Random(5)
    for _ in range(60):
        base = "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 300)))
        cut = rng.randrange(0, len(base) + 1)
        cases.append((base, base[:cut] + "#" + base[cut + 1 :], cut))
    got = evaluate(spark, [c[:2] for c in cases], text.first_char_divergence(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [c[2] for c in cases]


ALIAS_CASES = [
    # the word JOIN is taken as alias of users, rejected, and the real join is used up
    ("SELECT a FROM users JOIN orders o ON o.id = 1", {}, {"users": "JOIN"}),
    ("SELECT * FROM t WHERE x = 1", {}, {"t": "WHERE"}),
    ("FROM obs o JOIN sites AS s ON 1", {"obs": "o", "sites": "s"}, {"obs": "o", "sites": "s"}),
    ("FROM t a JOIN t b ON 1", {"t": "a"}, {"t": "a"}),
    ("FROM s.t a", {}, {}),
    ("FROM t SET x", {"t": "SET"}, {"t": "SET"}),
    ("FROM t AS 5", {}, {"t": "AS"}),
    (None, {}, {}),
]


def test_extract_aliases(spark):
    values = [(c[0], None) for c in ALIAS_CASES]
    got = evaluate(
        spark,
        values,
        sqltext.extract_aliases(F.col("a")),
        sqltext.extract_aliases(F.col("a"), skip_keywords=False),
    )
    assert got == [c[1:] for c in ALIAS_CASES]


NORMAL_CASES = [
    ("SELECT T1.a AS x, CAST(b AS INT) AS y FROM orders AS T1", "SELECT orders.a, CAST(b AS INT) FROM orders"),
    ("SELECT a FROM users JOIN orders o ON o.id=1", "SELECT a FROM users JOIN orders o ON o.id=1"),
    ("SELECT x FROM t WHERE(a)=1", "SELECT x FROM t WHERE(a)=1"),
    ("FROM t AS WHERE q", "FROM t AS WHERE q"),
    ("FROM t  AS   WHEREX q", "FROM t q"),
    ("FROM t WHERE$ x", "FROM t WHERE$ x"),
    # one alias after another: a becomes b, then that b becomes c
    ("SELECT a.x FROM b a JOIN c b ON 1", "SELECT c.x FROM b JOIN c ON 1"),
    # the last table of a repeated alias wins
    ("SELECT a.x FROM t a JOIN u a", "SELECT u.x FROM t JOIN u"),
    ("SELECT v.x FROM s.u$1 AS v WHERE y = 'v.z'", "SELECT s.u$1.x FROM s.u$1 WHERE y = 's.u$1.z'"),
    # only the part up to the first FROM loses its column aliases
    ("SELECT a AS b FROM (SELECT c AS d FROM e) f", "SELECT a FROM (SELECT c AS d FROM e) f"),
    ("select x from t as a\n where A.y=1", "select x from t where t.y=1"),
    ("", ""),
    (None, ""),
]


def test_remove_aliases(spark):
    got = one(spark, [c[0] for c in NORMAL_CASES], sqltext.remove_aliases(F.col("a")))
    assert got == [c[1] for c in NORMAL_CASES]


def test_restore_aliases_longest_first(spark):
    sql = "SELECT ab.x, a.b, AB.y FROM ab"
    aliases = F.create_map(F.lit("a"), F.lit("s"), F.lit("ab"), F.lit("l"))
    assert one(spark, [sql], sqltext.restore_aliases(F.col("a"), aliases)) == ["SELECT l.x, s.b, l.y FROM ab"]


TOKEN_CASES = [
    ("SELECT a.b, 'it''s' >= 1.5", ["SELECT", "a.b", ",", "'it''s'", ">=", "1.5"]),
    ("1e5 12", ["e5", "12"]),
    ("a || b % `c` [d]", ["a", "b", "c", "d"]),
    ("-- only\n", []),
    ("x -- c\n y /* z\n */ w", ["x", "y", "w"]),
    ("'a''b open", ["'a'", "b", "open"]),
    ("'a''b''c open", ["'a''b'", "c", "open"]),
    ('"q""r" <> t$1.*', ['"q""r"', "<>", "t$1", ".", "*"]),
    ("1.5e", ["1", ".", "e"]),
    ("/* open", ["/", "*", "open"]),
    (None, None),
]


def test_tokens_and_cover(spark):
    pieces = F.array_join(F.transform(sqltext.covering_pieces(F.col("a")), lambda p: p["piece"]), "")
    got = evaluate(spark, [(c[0], None) for c in TOKEN_CASES], sqltext.tokens(F.col("a")), pieces)
    assert [g[0] for g in got] == [c[1] for c in TOKEN_CASES]
    assert [g[1] for g in got] == [c[0] for c in TOKEN_CASES]


def test_long_literals_do_not_overflow(spark):
    long = "'" + "a''" * 60_000 + "'"
    rows = spark.createDataFrame([(long + " x",)], "a string")
    assert rows.select(sqltext.tokens(F.col("a"))).first()[0] == [long, "x"]


def test_raw_offsets_follow_survivors(spark):
    """Every token of the normalised text lies at its offset in the raw text."""
    cases = [
        "SELECT T1.a AS x, CAST(b AS INT) AS y FROM orders AS T1 JOIN u v ON T1.k = v.k WHERE T1.c = 'AS q'",
        "SELECT  x.o FROM orders  x  WHERE x.k = 12",
        "SELECT x FROM t x.y WHERE 1",
        "select a from t -- c AS d\n where b",
    ]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, a string")
    norm = rows.withColumn("tok", sqltext.tokens(sqltext.remove_aliases(F.col("a"))))
    each = norm.select("i", "a", F.posexplode("tok").alias("n", "t"))
    found = each.withColumn("off", sqltext.raw_token_offset(F.col("a"), F.col("n"))).collect()
    assert found
    for r in found:
        raw, tail = r.a[r.off :], r.t.split(".")[-1]
        # qualified names carry the table name instead of the alias
        head = raw.split()[0] if r.t[0] != "'" else raw
        assert raw.lower().startswith(r.t.lower().split(".")[0]) or tail in head, (r, raw)


def test_prompts(spark):
    m = prompts.MARKS
    user = m.head("user")
    cases = [
        user + m.gap + " q " + m.end + "rest",
        user + " q " + m.end,
        user + m.gap + " q ",
        " no header ",
    ]
    got = evaluate(
        spark,
        [(c, None) for c in cases],
        prompts.question_lenient(F.col("a")),
        prompts.question_strict(F.col("a")),
    )
    assert got == [("q", "q"), ("q", cases[1]), ("q", cases[2]), (cases[3], cases[3])]
    thoughts = ["<think>x</think> a </think> b ", "plain ", None]
    assert one(spark, thoughts, prompts.strip_reasoning(F.col("a"))) == ["a </think> b", "plain ", None]


@pytest.mark.parametrize(
    ("prompt", "expected"),
    [
        ("h\n\nT\n###Input:\nSchema:\nS1\n\nQ\n###Response:<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", ("S1", "Q")),
        ("a\n\nb", ("", "")),
        ("a\n\nb\n\nc", ("b", "c")),
    ],
)
def test_prompt_fields(spark, prompt, expected):
    assert tuple(one(spark, [prompt], prompts.prompt_fields(F.col("a")))[0]) == expected


def test_sample_fields(spark):
    sft = "###Input:\nSchema:\nS\n\nQ\n###Response:"
    qa = ["Do. ###Input:\nSchema:\nS\n\n Q ###Response:", "Do. ###Input:\nSchema:\nS", "Do."]
    assert tuple(one(spark, [sft], prompts.input_fields(F.col("a")))[0]) == ("S", "Q")
    got = one(spark, qa, prompts.question_fields(F.col("a")))
    assert [tuple(g) for g in got] == [("S", "Q"), ("S", ""), ("", "")]


def random_texts(seed, bits, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


WORKED_TOKENS = [
    ("SELECT a FROM t", ["SELECT", "a", "FROM", "t"]),
    ("a.b.c<=1.5", ["a.b.c", "<=", "1.5"]),
    ("x=='it''s'", ["x", "==", "'it''s'"]),
    ('"two ""words"""', ['"two ""words"""']),
    ("a -- note\nb", ["a", "b"]),
    ("a /* one\ntwo */ b", ["a", "b"]),
    ("/* open", ["/", "*", "open"]),
    ("'no end", ["no", "end"]),
    ("'a''b", ["'a'", "b"]),
    ("1.2.3", ["1.2", ".", "3"]),
    ("12ab", ["ab"]),
    ("é_x", ["_x"]),
    ("n\u00e9e$1", ["n\u00e9e$1"]),
    ("a!b ? # <>", ["a", "b", "<>"]),
    ("count(*)+(-2);", ["count", "(", "*", ")", "+", "(", "-", "2", ")", ";"]),
    ("a. b", ["a", ".", "b"]),
    ("--", []),
    ("", []),
]


def test_tokens_by_hand(spark):
    got = one(spark, [t for t, _ in WORKED_TOKENS], sqltext.tokens(F.col("a")))
    assert got == [expected for _, expected in WORKED_TOKENS]


def test_pieces_join_back(spark):
    bits = ["'", "''", '"', '""', "a", "b.c", " ", "1", ".", "2.5", "e", "--", "\n", "/*", "*/", "<", "=", "!", "$", "é", "_"]
    texts = random_texts(17, bits, 1500)
    pieces = sqltext.covering_pieces(F.col("a"))
    joined = F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
    marked = F.filter(F.transform(pieces, lambda p: p["token"]), lambda t: (t != "") & ~sqltext._is_comment(t))
    for source, (whole, found, tokens) in zip(texts, evaluate(spark, [(t, None) for t in texts], joined, marked, sqltext.tokens(F.col("a"))), strict=True):
        assert whole == source and found == tokens


WORKED_REFERENCES = [
    ("FROM t AS x", "FROM t"),
    ("from t x, u", "from t, u"),
    ("FROM t WHERE a", "FROM t WHERE a"),
    ("FROM t AS on", "FROM t AS on"),
    ("JOIN u.v w ON w.k = 1", "JOIN u.v ON w.k = 1"),
    ("FROM t JOIN u", "FROM t JOIN u"),
    ("FROM t onx", "FROM t"),
    ("FROM  t\n AS   x$1 (", "FROM  t (" ),
    ("FROM t AS", "FROM t AS"),
    ("FROM a b JOIN c d", "FROM a JOIN c"),
    ("XFROM t x", "XFROM t x"),
]


def test_kept_references_stay_whole(spark):
    """A keyword behind a table is no alias; anything else goes."""
    dropped = text.collapse_spaces(F.regexp_replace(F.col("a"), sqltext._ALIAS_DEFINITION, "$1$2"))
    got = one(spark, [t for t, _ in WORKED_REFERENCES], dropped)
    assert got == [" ".join(expected.split()) for _, expected in WORKED_REFERENCES]


def test_registered_functions_equal_the_column_functions(spark):
    from forkline.functions import registered
    from forkline.functions.prompts import strip_reasoning

    registered.register(spark)
    bits = ["SELECT ", "FROM ", "JOIN ", "t", "u.v", " ", " AS ", "x", "x.", "WHERE ", "'x.a'", "$", "INT", ", ", "ON ", "</think>", "--", "\n", "1.5", "A", "a"]
    texts = [*random_texts(31, bits, 1200), "SELECT CAST(x.a AS INT) AS n FROM t AS x WHERE x.b = 'x.c'", "<think>y</think> SELECT 1", ""]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "n int, a string")
    rows.createOrReplaceTempView("registered_texts")
    named = spark.sql(
        """SELECT n, sql_answer(a) AS answer, sql_normalized(a) AS normalized, map_entries(sql_aliases(a)) AS aliases, sql_token_list(a) AS tokens,
             sql_divergence(sql_token_list(a), sql_token_list(sql_normalized(a))) AS at FROM registered_texts"""
    )
    tokens, normal = sqltext.tokens(F.col("a")), sqltext.remove_aliases(F.col("a"))
    index = sqltext.first_divergence(tokens, sqltext.tokens(normal))
    columns = rows.select(
        "n",
        strip_reasoning(text.text_or_empty(F.col("a"))).alias("answer"),
        normal.alias("normalized"),
        F.map_entries(sqltext.extract_aliases(F.col("a"))).alias("aliases"),
        tokens.alias("tokens"),
        index.alias("index"),
        sqltext.divergence_reason(index, tokens, sqltext.tokens(normal)).alias("reason"),
    )
    flat = named.select("n", "answer", "normalized", "aliases", "tokens", "at.index", "at.reason")
    assert sorted(map(str, flat.collect())) == sorted(map(str, columns.collect()))


def test_survivors_are_the_normalised_tokens(spark):
    """Outside the fences lie as many tokens as the normalised text has, in its order."""
    words_ = [
        "SELECT", "a", "T1.b", "AS", "x", ",", "FROM", "orders", "AS", "T1", "JOIN", "u", "v", "ON", "v.k", "=",
        "'AS q'", "CAST", "(", "INT", ")", "WHERE", "1.5", "count", "*", "select", "from", "s.t", "\n",
    ]
    rng = random.Random(29)
    texts = [" ".join(rng.choice(words_) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    # An alias that a dot follows at its own definition is no SQL, and is left out.
    dotted = re.compile(r"(?i)\b(FROM|JOIN)\s+[\w.]+\s+(AS\s+)?\w+\.")
    texts = [t for t in texts if not dotted.search(t)]
    assert len(texts) > 800
    survivors = F.filter(
        F.transform(
            sqltext.covering_pieces(sqltext.fence_dropped(F.col("a"))),
            lambda p: F.regexp_replace(p["token"], sqltext.FENCED, ""),
        ),
        lambda t: t != "",
    )
    normal = sqltext.tokens(sqltext.remove_aliases(F.col("a")))
    got = evaluate(spark, [(t, None) for t in texts], survivors, normal)
    for source, (kept, tokens) in zip(texts, got, strict=True):
        assert len(kept) == len(tokens), source
        for k, t in zip(kept, tokens, strict=True):
            # a qualified name may carry its table in place of its alias
            assert k == t or k.split(".")[-1] == t.split(".")[-1], source
