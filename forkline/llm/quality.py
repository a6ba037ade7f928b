"""Quality rules with thresholds learnt from the corpus itself.

Each document is measured by a few integers. Per language and source, a histogram of every
measure (a quantile sketch that merges by adding counts) gives the quartiles, and a document
whose measure lies far outside them is rejected. All of it is built-in functions.

The sketch keeps seven leading bits of a value, so a quantile is at most 1/64 below the true
one. Counts add up, so the sketch of a language is the sum of those of its sources, and the
thresholds are the same whatever the order or number of tasks. Groups of fewer than
``min_docs`` documents take the thresholds of their language, and those of the whole corpus
where the language is as rare.

Nulls: a null text has no words and fails the base rules; null languages and sources form
groups of their own. Repeated rows are judged alike, each for itself. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forkline.llm.common import bind, blank_words, keep_table, packed, windows

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
UPPERS = r"[A-Z]"
MARKS = r"[!?{}\[\]=_~^\\@]"

#: Measure, and how far past its fence a value may lie before it counts. Per mille, but for
#: the length of words, which is in hundredths of a character.
SLACK = {"symbols": 15, "marks": 15, "dup_lines": 400, "repeats": 200, "uppers": 250, "word_length": 200}
#: Measures whose fence follows the tail of the group: it is the 99th percentile or the fence
#: without slack, whichever is higher, at least so many per mille and at most the fence
#: above. Most documents repeat nothing, so quartiles say little.
TAILS = {"dup_lines": 100, "repeats": 100}
#: Fences stand this many times the distance between the quartiles outside of them.
REACH = 3
MIN_DOCS = 100
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _found(text: Column, pattern: str) -> Column:
    """How often a text holds one of some characters."""
    return F.size(F.split(text, pattern)) - 1


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the hashes of all windows."""

    def walk(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]))
        return F.transform(twice, lambda x: x["p"])

    def total(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return bind(by_hash, lambda pairs: bind(F.sort_array(walk(pairs)), total))


def repeat_words(words: Column) -> Column:
    """Words in windows of five that the text holds twice or more, the first included.

    Windows are compared by 64-bit hashes. Most texts repeat none, which a set of the
    hashes shows; only the others are sorted.
    """
    none = F.lit(0).cast("bigint")
    return bind(windows(words, WINDOW), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(h)))


def counts(text: Column) -> Column:
    """What a text is measured by, as one struct."""

    def of(value: Column, words: Column) -> Column:
        lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        columns = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": _found(value, SYMBOLS),
            "n_marks": _found(value, MARKS),
            "n_uppers": _found(value, UPPERS),
            "n_repeat_words": repeat_words(words),
        }
        with_lines = lambda x: F.struct(
            *[c.cast("bigint").alias(k) for k, c in columns.items()],
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        )
        return bind(lines, with_lines)

    whole = F.coalesce(text, F.lit(""))
    return bind(whole, lambda value: bind(blank_words(value), lambda words: of(value, words)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _share(part: Column, whole: Column, scale: int) -> Column:
    return F.call_function("div", part * scale, F.greatest(whole, F.lit(1).cast("bigint")))


def measures(m: Column) -> dict[str, Column]:
    """The measures with thresholds, as whole numbers."""
    return {
        "symbols": _share(m["n_symbols"], m["word_chars"], 1000),
        "marks": _share(m["n_marks"], m["word_chars"], 1000),
        "dup_lines": _share(m["n_dup_lines"], m["n_lines"], 1000),
        "repeats": _share(m["n_repeat_words"], m["n_words"], 1000),
        "uppers": _share(m["n_uppers"], m["word_chars"], 1000),
        "word_length": _share(m["word_chars"], m["n_words"], 100),
    }


def sketch(measured: DataFrame) -> DataFrame:
    """Counts of rounded values per language, source and measure, and of their sums above.

    ``measured``: lang, source, m (see ``counts``). Documents that fail the base rules do
    not take part. Level 2 is a source in a language, 1 a language, 0 all.
    """
    good = measured.filter(~base_failed(F.col("m")))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures(F.col("m")).items()]))
    rows = good.select("lang", "source", pairs.alias("pair")).select("lang", "source", "pair.*")
    low_bits = F.greatest(F.length(F.bin("value")) - 7, F.lit(0))
    rounded = rows.withColumn("low", low_bits).withColumn("value", F.expr("shiftleft(shiftright(value, low), low)"))
    fine = rounded.groupBy("lang", "source", "measure", "value").agg(F.count("*").alias("n"))
    no = F.lit(None).cast("string")
    levels = F.explode(
        F.array(
            F.struct(F.lit(2).alias("level"), F.col("lang").alias("of_lang"), F.col("source").alias("of_source")),
            F.struct(F.lit(1).alias("level"), F.col("lang").alias("of_lang"), no.alias("of_source")),
            F.struct(F.lit(0).alias("level"), no.alias("of_lang"), no.alias("of_source")),
        )
    )
    return (
        fine.select(levels.alias("at"), "measure", "value", "n")
        .groupBy("at.level", "at.of_lang", "at.of_source", "measure", "value")
        .agg(F.sum("n").alias("n"))
    )


def fences(sketched: DataFrame) -> DataFrame:
    """Per level and group: documents, and the lower and upper fence of every measure."""
    group = ("level", "of_lang", "of_source", "measure")
    upto = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketched.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("value")))
    p99 = F.min(F.when(100 * F.col("upto") >= 99 * F.col("total"), F.col("value"))).alias("p99")
    quarters = ranked.groupBy(*group).agg(F.max("total").alias("docs"), quartile(1).alias("q1"), quartile(3).alias("q3"), p99)
    spread = REACH * (F.col("q3") - F.col("q1"))
    # All values that the sketch rounds to one are on the same side of it.
    tail = F.expr("p99 + shiftleft(1L, greatest(length(bin(p99)) - 7, 0)) - 1")
    pick = lambda name, c: F.max(F.when(F.col("measure") == name, c))

    def high(name: str) -> Column:
        loose = F.col("q3") + spread + SLACK[name]
        return F.least(loose, F.greatest(tail, F.col("q3") + spread, F.lit(TAILS[name]))) if name in TAILS else loose

    return quarters.groupBy("level", "of_lang", "of_source").agg(
        F.max("docs").alias("docs"),
        *[pick(k, high(k)).alias(f"high_{k}") for k in SLACK],
        pick("word_length", F.col("q1") - spread - SLACK["word_length"]).alias("low_word_length"),
    )


def thresholds(measured: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each language and source with a document that passes the base rules."""
    spark = measured.sparkSession
    table = keep_table(spark, fences(sketch(measured)), "fences")
    values = [c for c in table.columns if c.startswith(("high_", "low_"))]
    own = table.filter("level = 2").alias("own")
    lang = table.filter("level = 1").alias("lang")
    every = table.filter("level = 0").alias("every")
    joined = own.join(lang, F.col("own.of_lang").eqNullSafe(F.col("lang.of_lang")), "left").join(
        every, F.col("own.level") == F.col("every.level") + 2, "left"
    )
    chosen = [
        F.when(F.col("own.docs") >= min_docs, F.col(f"own.{c}"))
        .when(F.col("lang.docs") >= min_docs, F.col(f"lang.{c}"))
        .otherwise(F.col(f"every.{c}"))
        .alias(c)
        for c in values
    ]
    return joined.select(F.col("own.of_lang").alias("of_lang"), F.col("own.of_source").alias("of_source"), *chosen)


def inside(m: Column) -> Column:
    """Whether all measures keep to the fences of the joined thresholds."""
    kept = F.lit(True)
    for name, value in measures(m).items():
        kept = kept & (value <= F.col(f"high_{name}"))
        if name == "word_length":
            kept = kept & (value >= F.col(f"low_{name}"))
    return kept


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    on = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    failed = base_failed(F.col("m"))
    kept = F.when(failed, False).otherwise(F.coalesce(inside(F.col("m")), F.lit(True)))
    return measured.join(limits, on, "left").withColumn("base_failed", failed).withColumn("kept", kept)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", extra: tuple[str, ...] = ("doc_id",), min_docs: int = MIN_DOCS) -> DataFrame:
    """A verdict per document: ``extra`` columns, the counts, base_failed and kept."""
    spark = docs.sparkSession
    measured = docs.select(F.struct(*extra).alias("row"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), counts(F.col(text)).alias("m"))
    measured = keep_table(spark, measured, "measured")
    limits = keep_table(spark, thresholds(measured, min_docs), "thresholds")
    return _judged(measured, limits).select("row.*", *[F.col(f"m.{c}").alias(c) for c in COUNTS], "base_failed", "kept")


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents that pass, with all their columns.

    Texts are read and measured twice instead of being written and moved: only counts are
    shuffled, and the thresholds join texts by broadcast while they are small enough.
    """
    spark = docs.sparkSession
    # A generator keeps the counts from being copied into every filter that reads them.
    measured = F.explode(F.array(counts(F.col(text)))).alias("m")
    columns = [F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), measured]
    limits = keep_table(spark, thresholds(docs.select(*columns), min_docs), "thresholds")
    passing = packed(docs, *columns).filter(~base_failed(F.col("m")))
    return _judged(passing, limits).filter("kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _fence_sql() -> str:
    """The thresholds and verdicts over a table ``m`` of doc_id, lang, source and counts."""
    shares = {
        "symbols": "1000 * n_symbols // greatest(word_chars, 1)",
        "marks": "1000 * n_marks // greatest(word_chars, 1)",
        "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
        "uppers": "1000 * n_uppers // greatest(word_chars, 1)",
        "word_length": "100 * word_chars // greatest(n_words, 1)",
    }
    each = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS measure, {v} AS value FROM m WHERE NOT base_failed" for k, v in shares.items())
    slack = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLACK.items())
    tails = " ".join(f"WHEN '{k}' THEN least(plain + {SLACK[k]}, greatest(tail, plain, {v}))" for k, v in TAILS.items())
    return f"""
shares AS ({each}),
rounded AS (SELECT *, (value >> greatest(length(bin(value)) - 7, 0)) << greatest(length(bin(value)) - 7, 0) AS v FROM shares),
levels AS (
  SELECT 2 AS level, lang, source, measure, v FROM rounded UNION ALL
  SELECT 1, lang, NULL, measure, v FROM rounded UNION ALL SELECT 0, NULL, NULL, measure, v FROM rounded
),
fine AS (SELECT level, lang, source, measure, v, count(*) AS n FROM levels GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY v) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM fine
),
quarters AS (
  SELECT level, lang, source, measure, max(total) AS docs, min(CASE WHEN 4 * upto >= total THEN v END) AS q1,
         min(CASE WHEN 4 * upto >= 3 * total THEN v END) AS q3, min(CASE WHEN 100 * upto >= 99 * total THEN v END) AS p99 FROM ranked GROUP BY ALL
),
bounds AS (
  SELECT *, q3 + {REACH} * (q3 - q1) AS plain, p99 + (1::BIGINT << greatest(length(bin(p99)) - 7, 0)) - 1 AS tail,
         CASE measure {tails} ELSE plain + CASE measure {slack} END END AS high,
         CASE WHEN measure = 'word_length' THEN q1 - {REACH} * (q3 - q1) - {SLACK["word_length"]} ELSE -1 END AS low FROM quarters
),
broken AS (
  SELECT s.doc_id FROM shares s
  JOIN bounds own ON own.level = 2 AND own.measure = s.measure AND own.lang IS NOT DISTINCT FROM s.lang AND own.source IS NOT DISTINCT FROM s.source
  JOIN bounds lng ON lng.level = 1 AND lng.measure = s.measure AND lng.lang IS NOT DISTINCT FROM s.lang
  JOIN bounds every ON every.level = 0 AND every.measure = s.measure
  WHERE s.value > CASE WHEN own.docs >= {MIN_DOCS} THEN own.high WHEN lng.docs >= {MIN_DOCS} THEN lng.high ELSE every.high END
     OR s.value < CASE WHEN own.docs >= {MIN_DOCS} THEN own.low WHEN lng.docs >= {MIN_DOCS} THEN lng.low ELSE every.low END
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept FROM m
"""


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), win AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id
), m AS (
  SELECT doc_id, lang, source, len(words) AS n_words, length(list_aggregate(words, 'string_agg', '')) AS chars, coalesce(chars, 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '[!?{}\[\]=_~^\\@]')) AS n_marks,
         len(regexp_extract_all(text, '[A-Z]')) AS n_uppers, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, len(words) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(words) AS base_failed
  FROM t LEFT JOIN covered USING (doc_id)
),
""" + _fence_sql()
