"""Every operator and stage on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forkline.llm import decontaminate, licenses, linecrf, packing, pii, quality, recurrent, simhash, tokenfile, urls

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("row", "m", "kept", "fp", "key", "id", "h", "doc", "hash", "word", "number", "shard", "rule", "label", "of_lang", "n_words")
LONG = " ".join(f"w{i % 977}x{i % 313}" for i in range(30_000))


@pytest.fixture(scope="module")
def rows(spark):
    plain = "The quick brown fox jumps over the lazy dog again and again today."
    data = [
        (1, plain, "en", "a", 66),
        (2, plain, "en", "a", 66),
        (2, plain, "en", "a", 66),
        (3, None, "en", None, None),
        (4, "", None, "a", 0),
        (None, "No id here, but a text of more than ten words to keep it in.", None, None, 1),
        (None, None, None, None, None),
        (5, LONG, "de", "b", len(LONG)),
        (6, " \t\n", "de", "b", 3),
        (7, "one", "en", "a", 3),
        (8, "Write to jo.doe@mail.example.com. Licensed under the MIT License. Ünïcödé words here as well, and more.", "en", "a", 90),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def clashing(rows):
    for name in CLASHES:
        rows = rows.withColumn(name, F.lit("x"))
    return rows


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (None, ""), (3, "one"), (3, "one")], "item_id bigint, text string")


def sizes(spark, df):
    return df.count()


OPERATORS = {
    "op2": (lambda d, b: licenses.scan_licenses(d), 11),
    "op3": (lambda d, b: quality.quality_rules(d), 11),
    "op6": (lambda d, b: tokenfile.token_files(d, packing.tokenizer_path("byte_bpe_50k.json"), per_file=4), 11),
    "op7": (lambda d, b: simhash.near_duplicates(d), 11),
    "op9": (lambda d, b: pii.pseudonym_table(d, pii.KEY), 11),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_are_whole(spark, rows, clashing, bench, name):
    run, expected = OPERATORS[name]
    for docs in (rows, clashing):
        assert run(docs, bench).count() == expected
    assert run(rows.limit(0), bench).count() == 0


def test_decontamination(spark, rows, clashing, bench):
    for docs in (rows, clashing):
        found = decontaminate.contained_items(docs, bench).select("doc.id", "item_id").collect()
        assert sorted(map(tuple, found)) == [(1, 1), (2, 1), (7, 3)]
        left = decontaminate.decontaminate(docs, bench)
        assert left.columns == docs.columns and left.count() == 7
    assert decontaminate.contained_items(rows.limit(0), bench).count() == 0
    assert decontaminate.contained_items(rows, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(rows, bench.limit(0)).count() == 11


def test_short_items_inside_long_documents(spark):
    """Items of one to six words, wherever their words stand, against plain windows."""
    import random

    rng = random.Random(2)
    words = "a b c d e f".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    items = [(100 + n, " ".join(rng.choice(words) for _ in range(n % 6 + 1))) for n in range(24)]

    def shingles(text, n):
        w = text.split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    expected = set()
    for item, text in items:
        n = min(5, len(text.split()))
        own = shingles(text, n)
        expected |= {(i, item, len(own), len(own & shingles(t, n))) for i, t in docs if 100 * len(own & shingles(t, n)) >= 80 * len(own)}
    for some in (items, [x for x in items if len(x[1].split()) != 3], [x for x in items if len(x[1].split()) < 3]):
        found = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(some, "item_id bigint, text string"))
        kept = {i for i, _ in some}
        assert sorted(map(tuple, found.select("doc.id", "item_id", "n_item", "n_shared").collect())) == sorted(e for e in expected if e[1] in kept)


def test_packing(spark, rows, clashing):
    for docs in (rows, clashing):
        made = packing.best_fit(docs, packing.tokenizer_path("word_bpe_49k.json"), shard=5).collect()
        assert len([r for r in made if r["piece"] == 0]) == 11
        assert [r["length"] for r in made if r["doc_id"] == 3] == [1]
    assert packing.best_fit(rows.limit(0), packing.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_language_model(spark, rows, clashing):
    for docs in (rows, clashing):
        corpus = recurrent.count_tokens(docs, head=5)
        encoded = recurrent.encode(docs, corpus, F.lit(True))
        got = recurrent.score_documents(encoded, corpus, recurrent.fit(encoded, corpus))
        assert got.count() == 11 and got.filter("score IS NULL OR n_known <> n_tokens OR isnan(score)").count() == 0
    none = recurrent.count_tokens(rows.limit(0))
    nothing = recurrent.encode(rows.limit(0), none, F.lit(True))
    untrained = recurrent.fit(nothing, none)
    assert recurrent.score_documents(nothing, none, untrained).count() == 0
    got = recurrent.score_documents(recurrent.encode(rows, none, F.lit(False)), none, untrained).collect()
    assert len(got) == 11 and all(r["n_known"] == 0 and r["base_score"] == 0 for r in got)


def test_classifier(spark, rows, clashing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (2, 1), (6, 0), (7, None), (None, 1), (99, 0)], "doc_id bigint, quality int")
    for docs in (rows, clashing):
        field = linecrf.learn(docs, labels)
        scores = [r[0] for r in docs.select(linecrf.quality_scores(docs, field)).collect()]
        assert len(scores) == 11 and all(0 <= s <= 1 for s in scores)
    one_sided = linecrf.learn(rows, labels.filter("quality = 1"))
    assert one_sided.constant == 1.0
    assert linecrf.learn(rows, labels.limit(0)).constant == 0.5


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.Example.net/en/1", "r"), (1, "http://A.Example.net/en/1", "r"), (2, None, "r"), (None, "x", "r"), (3, "http://net", "r"), (4, "ftp://net/a?b", "r"), (5, "://", "r"), (6, "http://" + "a." * 300 + "org/fr/" + "b/" * 3000, "r")],
        "page_id bigint, url string, rule string",
    )
    got = urls.url_verdicts(pages, urls.rule_table(spark)).select("row.page_id", "rule", "verdict").collect()
    assert sorted(map(str, got)) == sorted(
        map(
            str,
            spark.createDataFrame(
                [(1, "example.net/en/", "allow"), (1, "example.net/en/", "allow"), (2, None, "allow"), (None, None, "allow"), (3, None, "allow"), (4, "net/", "block"), (5, None, "allow"), (6, "org/fr/", "allow")],
                "page_id bigint, rule string, verdict string",
            ).collect(),
        )
    )
    assert urls.url_verdicts(pages, urls.rule_table(spark).limit(0)).count() == 8
    assert urls.url_verdicts(pages.limit(0), urls.rule_table(spark)).count() == 0


def test_stages(spark, rows, clashing, small):
    for docs in (rows, clashing, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns, name
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, small).count()


def test_near_duplicate_stage_keeps_one_row(spark, rows):
    kept = simhash.drop_near_duplicates(rows).groupBy("doc_id", "text").count().collect()
    ids = sorted((r["doc_id"] or 0) for r in kept)
    # 1 and 2 are copies; 3, 4, 6 and the row without id or text are empty.
    assert ids == [0, 1, 3, 5, 7, 8] and all(r["count"] == 1 for r in kept)
