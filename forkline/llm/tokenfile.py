"""Token ids as Simple-8b words in files: written in order of document ids, read back vectorised.

A 64-bit word holds a selector in its four high bits and as many ids as fit in the other 60
at one width: 60 of one bit down to one of 60 bits. Selector 15 is an escape: it holds
nothing, and the next word is one value of 64 bits as it stands. (The run-length selectors
of the original code are left out; ids hardly ever repeat.) Ids are coded in blocks of
``BLOCK``; a record keeps where each block's words start, so that blocks are coded and decoded
independently, all those of a batch at once.

Format. A token file is a Parquet file of records, one per document, in ascending order:
file_no, row_no, doc_id, n_tokens, blocks (32-bit word offsets) and words (little-endian
bytes). Parquet is the envelope because its writers commit whole files on any store, also
when executors are lost; a record's payload is the binary format itself.

Order. Documents are dealt to files by ranges of their id, ties by a hash of the text, and
sorted there before they are encoded, so texts move once and ids never do. How many files follows from the
number of documents and their bytes. ``start`` is a running sum inside each file plus the totals of the files
before it.

Nulls: a null text is the end id alone. Documents without an id come first; the hash spreads
them over files like any others, and it decides the order among equal ids. Rows that repeat
in full are equal anyhow. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forkline.llm.packing import tokenizer_path
from forkline.llm.tokens import encoder
from forkline.session import scratch_root

BLOCK = 256
#: Documents and bytes of text that a file is made for.
PER_FILE, FILE_BYTES = 20_000, 1 << 24
#: Ids in a word by selector, and bits of each: 60 // count.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // n for n in COUNTS)
ESCAPE = 15
#: Bits of the values that nearly all ids are among.
_SMALL = np.array([max(1, v.bit_length()) for v in range(1 << 16)], np.uint8)
SCHEMA = "file_no int, row_no bigint, key string, n_tokens bigint, blocks array<int>, words binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each value needs, one at least."""
    if not len(values) or values.max() < len(_SMALL):
        return _SMALL[values]
    bits = np.ones(len(values), np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= np.uint64(1) << np.uint64(step)
        bits += (high * step).astype(np.uint8)
        rest = np.where(high, rest >> np.uint64(step), rest)
    return bits


def encode_blocks(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of consecutive blocks, and where each block's words start (and the last end).

    ``ends``: where each block ends in ``values``. Every word takes as many values as it can.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(len(ends) + 1, np.int64)
    bits = _bits(values)
    sizes = np.diff(np.concatenate([[0], ends]))
    # Places left in the block, 60 at most: bytes are enough for all that is compared.
    room = np.full(n, 60, np.uint8)
    for back in range(1, min(60, int(sizes.max())) + 1):
        room[(ends - back)[sizes >= back]] = back
    # Widest value in the next ``count`` ones; windows that leave the block do not count.
    selector = np.full(n, len(COUNTS) - 1, np.uint8)
    widest, span = bits, 1
    for k in range(len(COUNTS) - 2, -1, -1):
        count = COUNTS[k]
        while span < count:
            step = min(span, count - span)
            shifted = np.full(n, 64, np.uint8)
            shifted[: n - step] = widest[step:]
            widest = np.maximum(widest, shifted)
            span += step
        np.putmask(selector, (room >= count) & (widest <= WIDTHS[k]), k)
    selector[bits > 60] = ESCAPE
    taken = np.array([*COUNTS, 0, 1], np.uint8)[selector]
    # From word to word in all blocks at once.
    at_word = np.concatenate([[0], ends[:-1]])
    limit = np.asarray(ends)
    steps = []
    while len(at_word):
        going = at_word < limit
        at_word, limit = at_word[going], limit[going]
        steps.append(at_word)
        at_word = at_word + taken[at_word]
    heads = np.sort(np.concatenate(steps))
    kind = selector[heads].astype(np.int64)
    size = 1 + (kind == ESCAPE)
    at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for k in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == k)
        if k == ESCAPE:
            words[at[rows]] = np.uint64(ESCAPE) << np.uint64(60)
            words[at[rows] + 1] = values[heads[rows]]
            continue
        packed = np.full(len(rows), np.uint64(k) << np.uint64(60), np.uint64)
        for place in range(COUNTS[k]):
            packed |= values[heads[rows] + place] << np.uint64(place * WIDTHS[k])
        words[at[rows]] = packed
    first = np.searchsorted(heads, np.concatenate([[0], ends]))
    return words.astype("<u8"), np.append(at, len(words))[first]


def decode_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of words that follow each other, and where each word's values start (and the last end).

    Words after an escape have no values of their own.
    """
    words = np.asarray(words, "<u8").astype(np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    escapes = np.flatnonzero(kind == ESCAPE)
    for at in escapes.tolist():  # rare; a raw word may look like an escape
        if not raw[at]:
            raw[at + 1] = True
    raw = raw[:-1]
    count = np.array([*COUNTS, 0, 1])[kind]
    count[raw] = 0
    after = np.concatenate([[0], np.cumsum(count)])
    values = np.zeros(after[-1], np.uint64)
    for k in np.unique(kind[~raw]).tolist():
        rows = np.flatnonzero((kind == k) & ~raw)
        if k == ESCAPE:
            values[after[rows]] = words[rows + 1]
            continue
        mask = np.uint64((1 << WIDTHS[k]) - 1)
        for place in range(COUNTS[k]):
            values[after[rows] + place] = words[rows] >> np.uint64(place * WIDTHS[k]) & mask
    return values, after


def encode_documents(texts: list[np.ndarray]) -> list[tuple[int, list[int], bytes]]:
    """For each document n_tokens, word offsets of its blocks, and its words as bytes."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts])
    values = np.concatenate(texts)
    ends, owner = [], []
    at = 0
    for n, size in enumerate(sizes.tolist()):
        stops = [*range(at + BLOCK, at + size, BLOCK), at + size]
        ends += stops
        owner += [n] * len(stops)
        at += size
    words, first = encode_blocks(values, np.array(ends))
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    result = []
    for n in range(len(texts)):
        a, b = bounds[n], bounds[n + 1]
        result.append((int(sizes[n]), (first[a:b] - first[a]).tolist(), words[first[a] : first[b]].tobytes()))
    return result


def _records(path: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, row = encoder(path, drops_blanks=False), 0
        for batch in batches:
            files, keys, size, group = batch["file_no"].to_numpy(), iter(batch["key"].tolist()), 0, []

            def frame():
                nonlocal row
                made = encode_documents(group)
                row += len(made)
                return pd.DataFrame({"file_no": files[: len(made)], "row_no": np.arange(row - len(made), row), "key": [next(keys) for _ in made], "n_tokens": [m[0] for m in made], "blocks": [m[1] for m in made], "words": [m[2] for m in made]})

            for ids in tokens.encode(batch["text"].tolist()):
                group.append(ids)
                size += len(ids)
                if size > 1 << 20:
                    yield frame()
                    group, size = [], 0
            if group:
                yield frame()

    return rows


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts = [np.frombuffer(w, "<u8") for w in batch["words"]]
        crc = []
        group: list[np.ndarray] = []
        held = 0

        def flush():
            values, after = decode_words(np.concatenate(group))
            plain = values.astype("<u4")
            at = 0
            for part in group:
                crc.append(zlib.crc32(plain[after[at] : after[at + len(part)]].tobytes()))
                at += len(part)
            group.clear()

        for part in parts:
            group.append(part)
            held += len(part)
            if held > 1 << 18:
                flush()
                held = 0
        if group:
            flush()
        yield batch[["file_no", "row_no", "key", "n_tokens"]].assign(ids_crc32=np.array(crc, np.int64))


def write_token_files(docs: DataFrame, path: str, target: str, doc_id: str = "doc_id", text: str = "text", per_file: int = PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Encode every text and write the token files to ``target``."""
    sums = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    files = max(1, -(-sums["n"] // per_file), -(-sums["bytes"] // file_bytes))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(files, "id", "tie").sortWithinPartitions("id", "tie")
    filed = ordered.select(F.spark_partition_id().alias("file_no"), F.col("id").cast("string").alias("key"), "text")
    filed.mapInPandas(_records(path), SCHEMA).write.parquet(target)


def read_token_files(spark: SparkSession, target: str) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every document, from the ids in the files."""
    stored = spark.read.schema(SCHEMA).parquet(target).select("file_no", "row_no", "key", "n_tokens", "words")
    found = stored.mapInPandas(_decoded, "file_no int, row_no bigint, key string, n_tokens bigint, ids_crc32 bigint")
    inside = Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    totals = stored.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
    files = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("file_no").alias("of_file"), F.coalesce(F.sum("total").over(files), F.lit(0)).alias("base"))
    joined = placed.join(bases, F.col("file_no") == F.col("of_file"))
    return joined.select("key", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", per_file: int = PER_FILE) -> DataFrame:
    """Write the ids of ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    target = f"{scratch_root(spark).rstrip('/')}/forkline-tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, target, doc_id, text, per_file)
    kind = docs.schema[doc_id].dataType
    return read_token_files(spark, target).withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", "doc_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files(docs, tokenizer_path("byte_bpe_50k.json"))
