"""Near-duplicates by SimHash, with candidates from Golay codewords.

A text's fingerprint holds, per bit, the majority over the 64-bit hashes of its three-word
shingles. Fingerprints that differ in at most two bits are linked, and linked documents
form groups.

Candidates. The 64 bits are cut into three segments of 22, 21 and 21. Two errors leave at
least one segment without any, and one can be chosen such that the segment after it has at
most one: the errors are (0, 0, 2) or (0, 1, 1) in some order, or fewer. So a key is a
segment as it stands together with a codeword index of the segment after it. A segment,
filled up to 24 bits, is decoded by the extended Golay code to its nearest codewords: one
if the nearest is at distance three or less, six if at distance four. Two words one bit
apart always share a codeword: one of them, of odd weight, lies at distance one or three
from its only nearest codeword c. The other then is at most four away from c. At four it
can have no codeword within two, which would be within three of the first, so c is one of
its six; nearer than four, c is its only nearest. A
fingerprint has about ten keys of some 33 bits.

Large buckets. Only distinct fingerprints are compared, so copies never meet. A bucket of at
most ``bucket`` fingerprints is compared pair by pair. For fingerprints of larger buckets all
neighbours are found in another exact way, linear in their number: two fingerprints are at
most two bits apart exactly if some word is at most one bit from both, so each gets its 65
such words and is linked to the smallest fingerprint that shares one. No link between groups
is lost by either.

Groups are the components of these links, by alternating stars over tables in the shared
folder. Nulls: a null or empty text has fingerprint zero and is linked like any other; a
document with a null id belongs to a group but never names it (the group's name is null if
no member has an id). Repeated rows are members alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import keep_table, packed

SEED = 42
BUCKET = 64
SHINGLE = 3
CHUNK = 1 << 16
#: Fixed: the generator polynomial of the binary Golay code of length 23.
POLYNOMIAL = 0b101011100011


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    total, half = np.zeros(64, np.int64), len(words) - size + 1
    for start in range(0, half, CHUNK):
        part = words[start : start + CHUNK + size - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(size)]))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * total > half, bitorder="little")
    return int(ones.view(np.int64)[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp for every row."""
    of = F.pandas_udf(_fingerprints, "bigint")
    return docs.select(F.col(doc_id).alias("doc_id"), of(F.col(text)).alias("fp"))


@cache
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """For every 12-bit syndrome the patterns of least weight (six at most), and how many."""
    remainders = []
    for place in range(24):
        if place == 23:  # the parity bit alone: its syndrome is odd parity
            remainders.append(1 << 11)
            continue
        value = 1 << place
        for bit in range(place, 10, -1):
            if value >> bit & 1:
                value ^= POLYNOMIAL << (bit - 11)
        remainders.append(value | 1 << 11)
    leaders: dict[int, list[int]] = {}
    weight: dict[int, int] = {}
    patterns = [(0, 0, -1)]
    for w in range(5):
        longer = []
        for syndrome, pattern, last in patterns:
            if weight.setdefault(syndrome, w) == w:
                leaders.setdefault(syndrome, []).append(pattern)
            longer += [(syndrome ^ remainders[p], pattern | 1 << p, p) for p in range(last + 1, 24)]
        patterns = longer
    table, size = np.zeros((4096, 6), np.int64), np.zeros(4096, np.int64)
    for syndrome, group in leaders.items():
        table[syndrome, : len(group)] = group
        size[syndrome] = len(group)
    return table, size


def nearest_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the nearest codewords of 24-bit words: which word, and a 12-bit index."""
    table, size = _decoder()
    rest = words & ((1 << 23) - 1)
    parity = np.bitwise_count(words.astype(np.uint64)).astype(np.int64) & 1
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (POLYNOMIAL << (bit - 11)), rest)
    syndrome = rest | parity << 11
    which = np.repeat(np.arange(len(words)), size[syndrome])
    nth = np.arange(len(which)) - np.repeat(np.cumsum(size[syndrome]) - size[syndrome], size[syndrome])
    code = words[which] ^ table[syndrome[which], nth]
    return which, code >> 11 & 0xFFF


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of fingerprints: which fingerprint, and the key."""
    values = fps.astype(np.uint64)
    segments = [(values & np.uint64((1 << 22) - 1)), (values >> np.uint64(22)) & np.uint64((1 << 21) - 1), values >> np.uint64(43)]
    segments = [s.astype(np.int64) for s in segments]
    which, keys = [], []
    for k in range(3):
        at, index = nearest_codewords(segments[(k + 1) % 3])
        which.append(at)
        keys.append(k << 34 | segments[k][at] << 12 | index)
    return np.concatenate(which), np.concatenate(keys)


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy()
        which, keys = keys_of(fps)
        yield pd.DataFrame({"key": keys, "fp": fps[which]})


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links a < b between distinct fingerprints at most two bits apart.

    All of them for small buckets; for large ones enough to connect what is connected.
    """
    spark = fps.sparkSession
    keys = keep_table(spark, fps.select("fp").mapInPandas(_key_rows, "key bigint, fp bigint"), "simhash-keys")
    sizes = keep_table(spark, keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-buckets")
    small = keys.join(sizes.filter(F.col("n") <= bucket).select("key"), "key", "left_semi")
    a, b = small.alias("a"), small.alias("b")
    near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    hot = keys.join(sizes.filter(F.col("n") > bucket).select("key"), "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(np.int64(np.uint64(1 << k)).item()) for k in range(64)])
    around = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    first = around.groupBy("word").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1").select("word", "least")
    stars = around.join(first, "word").filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root: the smallest node of each component with a link; nodes are whole numbers.

    Large and small stars in turn: every node points its larger neighbours, then its smaller
    ones, at the smallest node it sees, until nothing moves.
    """
    spark = edges.sparkSession
    current = keep_table(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    seen = None
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following = keep_table(spark, small.select("e.*").filter("u <> v").distinct(), name)
        state = following.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        current = following
        if state == seen:
            return current.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        seen = state


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """Per row of ``docs``: doc_id, fp, fingerprint in hexadecimal and component_id."""
    spark = docs.sparkSession
    marked = keep_table(spark, with_fingerprint(docs, text, doc_id), "simhash")
    fps = keep_table(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = keep_table(spark, components(links(fps, bucket), "simhash-stars"), "simhash-roots")
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = rooted.select("fp", "root").join(named, "root").select(F.col("fp").alias("of_fp"), "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(groups, F.col("fp") == F.col("of_fp"), "left").select("doc_id", "fp", digits, "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of every group, with all its columns: that of the smallest id.

    What goes is joined, not what stays, as it is the smaller table by far: while Spark can
    broadcast it, texts are not moved. Rows of one id share their fate: they stay if one of
    them does, and rows that repeat in full are reduced to one. A row without an id stays if
    no member of its group has one, and such a group keeps all of them.
    """
    spark = docs.sparkSession
    groups = keep_table(spark, near_duplicates(docs, text, doc_id).select("doc_id", "fp", "component_id"), "simhash-groups")
    stays = (F.col("doc_id") == F.col("component_id")).cast("bigint")
    fates = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum(stays).alias("staying"))
    leaving = keep_table(spark, fates.filter("staying <> 1"), "simhash-leaving")
    unnamed = keep_table(spark, groups.filter("doc_id IS NULL AND component_id IS NULL").select("fp").distinct(), "simhash-unnamed")
    rows = packed(docs, F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kept = [rows.filter("id IS NOT NULL").join(leaving, F.col("id") == F.col("doc_id"), "left_anti").select("row")]
    twice = leaving.filter("staying > 1")
    if not twice.isEmpty():
        repeated = rows.join(twice, F.col("id") == F.col("doc_id"), "left_semi")
        kept.append(repeated.groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("row").alias("row")).select("row"))
    if not unnamed.isEmpty():
        of = F.pandas_udf(_fingerprints, "bigint")
        nameless = rows.filter("id IS NULL").withColumn("fp", of("text"))
        kept.append(nameless.join(unnamed, "fp", "left_semi").select("row"))
    result = kept[0]
    for more in kept[1:]:
        result = result.unionByName(more)
    return result.select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
