"""Corpus operators on planted cases."""

import random
from datetime import date

from pyspark.sql import functions as F

from forkline.llm import pii, quality, simhash


def test_groups_of_the_stage_keep_their_smallest_id(spark):
    """Fingerprints at most two bits apart leave together; any others stay."""
    draw = random.Random(7)
    rows, stay = [], set()
    for g in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(2000)]
        other = [f"v{w}" for w in words]
        rows += [(f"{g:03d}-a", " ".join(words)), (f"{g:03d}-b", "\n".join(words)), (f"{g:03d}-c", " ".join(words).upper()), (f"{g:03d}-d", " ".join(other))]
        stay |= {f"{g:03d}-a", f"{g:03d}-d"}
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == stay


def test_near_copies_of_empty_nameless_and_repeated_rows(spark):
    rows = [("b", ""), ("a", None), (None, "one two three"), (None, "one  two three"), (None, "four"), ("c", "four"), ("d", "six"), ("d", "six")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    kept = simhash.drop_near_duplicates(docs).select(F.coalesce("doc_id", F.lit("-")).alias("i")).collect()
    assert sorted(r.i for r in kept) == ["-", "-", "a", "c", "d"]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_each_quality_rule_alone_rejects(spark):
    """One document for each measure is far out in it and inside of all other fences."""
    plain = [" ".join(f"{chr(97 + n % 7)}{n:03d}{k:02d}" for k in range(80)) for n in range(200)]
    words = [f"r{n:04d}" + "x" for n in range(80)]
    odd = {
        "symbols": plain[0].replace("a00001", "#" * 30),
        "marks": plain[0].replace("a00001", "!" * 30),
        "dup_lines": "\n".join("again0" if n % 4 == 0 else f"d{n:03d}xx" for n in range(100)),
        "repeats": " ".join(words + words[:6]),
        "uppers": " ".join(f"ABC{n:03d}" for n in range(80)),
        "word_length": " ".join(f"{n:02d}" * 6 for n in range(80)),
    }
    rows = [(f"plain{n}", t, "en", "web") for n, t in enumerate(plain)] + [(k, t, "en", "web") for k, t in odd.items()]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string").cache()
    kept = {r.doc_id for r in quality.quality_filter(docs).collect()}
    assert kept == {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    assert kept == {f"plain{n}" for n in range(len(plain))}
    measured = docs.select("doc_id", "lang", "source", quality.counts(F.col("text")).alias("m"))
    limits = quality.thresholds(measured).first()
    for row in measured.select("doc_id", quality.base_failed(F.col("m")).alias("failed"), *[v.alias(k) for k, v in quality.measures(F.col("m")).items()]).collect():
        if row.doc_id in odd:
            beyond = {k for k in odd if row[k] > limits[f"high_{k}"]} | ({"word_length"} if row.word_length < limits.low_word_length else set())
            assert not row.failed and beyond == {row.doc_id}


def test_pii_beside_words_separators_and_far_dates():
    def kinds(text):
        return [(kind, text[a:b]) for kind, a, b in pii.pseudonymise(text, pii.KEY)[1]]

    iban = "BE68 5390 0754 7034"
    for text in (f"{iban} BIC GKCCBEBB", f"{iban} 2024", f"AB12 ABCD {iban} EUR", "".join(iban.split()) + " EUR"):
        assert [k for k, _ in kinds(text)] == ["iban"]
    assert kinds(f"{iban} BIC") == [("iban", iban)]
    assert kinds("DE89 3704 0044 0532 0130 00 BIC") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("Tel.+49 30 1234567") == [("phone", "+49 30 1234567")]
    assert kinds("Tel.555-123-4567") == [("phone", "555-123-4567")]
    assert kinds("card,4111111111111111") == [("card", "4111111111111111")]
    assert kinds("host.10.0.0.1 born.1999-01-02") == [("ip", "10.0.0.1"), ("date", "1999-01-02")]
    assert not kinds("3.4111111111111111 3,4111111111111111 1.555-123-4567 1.10.0.0.1 BE68 5390 0754 7035 BIC")


def test_far_dates_keep_apart():
    made = {}
    for n in [*range(1, 3000), *range(date(1899, 12, 1).toordinal(), date(1900, 2, 1).toordinal()), date.max.toordinal()]:
        day = date.fromordinal(n)
        new = pii.pseudonymise(day.isoformat(), pii.KEY)[0]
        assert new != day.isoformat() and (1900 <= date.fromisoformat(new).year < 2100) == (1900 <= day.year < 2100)
        made[new] = n
    assert len(made) == 2999 + 62 + 1
