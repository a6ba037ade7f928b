"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is in a document if at least 80 % of the item's distinct five-word shingles are
among the document's, however long the document and wherever they stand.

Search. Shingles are ordered by a hash. Items are partitioned by their number of shingles n,
and all items of one size keep the k = n - ceil(0.8 n) + 1 smallest hashes, a bottom-k MinHash
sketch. A document with 80 % of the shingles misses at most n - ceil(0.8 n) of them, hence
holds one of any k: every document that contains an item meets its sketch, so nothing is
missed, and a document that meets none is left at once. (Banding a whole-document MinHash, the
usual form, cannot see an item of 20 shingles in a document of 20,000 at any useful number of
hashes; the sketch on the item's side keeps the search by MinHash and makes it complete.)
Documents with fewer distinct shingles than a size partition needs are no candidates for it.

Verification. For candidates only, the shingles themselves are compared as texts and counted.

Words are runs of letters and digits in the lower-cased text. An item of fewer than five words
is one shingle of its own length; documents are probed with windows of that length as well, for
those of the lengths one to four that some item has, so it is found wherever its words stand.

Scale. The shingles of documents are not shuffled while the sketches are small enough for
Spark to broadcast them (their real size is known, they are read from a table); beyond that
Spark joins them by the hash, and skewed hashes are split. Candidates are deduplicated before
they are joined back, so passages that a third of all documents share cost one row each.

Nulls: null texts or items have no shingles and meet nothing. A document is known by its id
and its text's hash, so rows of a null id stay apart; rows repeated in full count once. Items
with the same id are one item each per text. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import bind, keep_table, packed, windows

WINDOW = 5
SIMILARITY = 80  # per cent
#: Everything below 0x80 that is no letter or digit.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS), "")


def window_texts(words: Column, size: int) -> Column:
    """The windows of ``size`` words as texts; none where there are fewer."""
    each = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) >= size, each).otherwise(F.array().cast("array<string>"))


def _of_lengths(text: Column, lengths: list[int], make) -> Column:
    """Distinct windows of all ``lengths`` of a text; those of different lengths differ."""
    return bind(_words(text), lambda w: F.array_distinct(F.concat(*[make(w, n) for n in lengths])))


def _of_item(text: Column, make) -> Column:
    """An item's own shingles: windows of five words, or all its words if it has fewer."""

    def own(words: Column) -> Column:
        shingles = make(words, WINDOW)
        for n in range(1, WINDOW):
            shingles = F.when(F.size(words) == n, make(words, n)).otherwise(shingles)
        return F.array_distinct(shingles)

    return bind(_words(text), own)


def _needed(n: Column, similarity: int) -> Column:
    return F.call_function("div", n * similarity + 99, F.lit(100)).cast("int")


def sketches(items: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """hash, item (id and text hash), needed: the bottom-k sketch of every item."""
    hashed = items.select("item", F.sort_array(_of_item(F.col("text"), windows)).alias("hashes")).filter(F.size("hashes") > 0)
    n = F.size("hashes")
    sized = hashed.select("item", "hashes", _needed(n, similarity).alias("needed"), n.alias("n"))
    kept = F.slice("hashes", 1, F.col("n") - F.col("needed") + 1)
    return sized.select("item", "needed", F.explode(kept).alias("hash"))


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """doc (id, text hash), item_id, n_item, n_shared: one row per document and item it contains."""
    spark = docs.sparkSession
    bench = items.select(F.struct(F.col(item_id).alias("id"), F.xxhash64(item_text).alias("h")).alias("item"), F.col(item_text).alias("text")).distinct()
    bench = keep_table(spark, bench, "bench-items")
    sketch = keep_table(spark, sketches(bench, similarity), "bench-sketches")
    whole = keep_table(spark, bench.select("item", F.explode(_of_item(F.col("text"), window_texts)).alias("shingle")), "bench-shingles")
    sizes = whole.groupBy("item").agg(F.count("*").alias("n_item"))
    # At most four lengths besides the usual one.
    short = bench.select(F.size(_words(F.col("text"))).alias("n")).filter(F.col("n").between(1, WINDOW - 1)).distinct().collect()
    lengths = [WINDOW, *sorted(r["n"] for r in short)]
    keys = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h")).alias("doc")

    # A generator keeps the hashes from being computed once more for their number.
    hashes = docs.select(keys, F.explode(F.array(_of_lengths(F.col(text), lengths, windows))).alias("hashes"))
    probes = hashes.select("doc", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    met = probes.join(sketch, "hash").filter(F.col("n") >= F.col("needed")).select("doc", "item").distinct()
    candidates = keep_table(spark, met, "bench-candidates")

    of = candidates.select("doc").distinct().select(F.col("doc.id").alias("id"), F.col("doc.h").alias("h"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    suspects = rows.join(of, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("h")), "left_semi").distinct()
    shingles = suspects.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("doc"), F.explode(_of_lengths(F.col("text"), lengths, window_texts)).alias("shingle"))
    shared = shingles.join(whole, "shingle").groupBy("doc", "item").agg(F.count("*").alias("n_shared"))
    verified = shared.join(candidates, ["doc", "item"], "left_semi").join(sizes, "item")
    enough = F.col("n_shared") * 100 >= F.col("n_item") * similarity
    return verified.filter(enough).select("doc", F.col("item.id").alias("item_id"), "n_item", "n_shared")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    found = contained_items(docs, items, doc_id, text, item_id, item_text, similarity).select("doc").distinct()
    leaks = keep_table(docs.sparkSession, found.select(F.col("doc.id").alias("leak_id"), F.col("doc.h").alias("leak_h")), "leaks")
    rows = packed(docs, F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    return rows.join(leaks, F.col("id").eqNullSafe(F.col("leak_id")) & (F.col("h") == F.col("leak_h")), "left_anti").select("row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("doc.id").alias("doc_id"), "item_id", "n_item", "n_shared")


_WORDS = r"SELECT {id} AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"
OP1_SQL = f"""
WITH dw AS ({_WORDS.format(id="doc_id", table="documents")}), bw AS ({_WORDS.format(id="item_id", table="benchmark")}),
lengths AS (SELECT DISTINCT least(len(w), {WINDOW}) AS n FROM bw WHERE len(w) > 0),
d AS (SELECT DISTINCT id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)),
b AS (SELECT DISTINCT id, array_to_string(list_slice(w, i, i + {WINDOW} - 1), ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n_item FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n_item) AS n_item, count(*) AS n_shared
FROM d JOIN b USING (s) JOIN sizes ON sizes.id = b.id GROUP BY d.id, b.id HAVING 100 * count(*) >= {SIMILARITY} * any_value(n_item)
"""
