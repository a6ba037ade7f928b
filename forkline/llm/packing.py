"""Best-fit packing of token sequences by a swap-based local search.

Every text is encoded whole, and only texts of more than ``CAPACITY`` ids are cut. At first every
piece is a sequence of its own, in order of arrival. The local search does all of the packing: a piece
moves to the fullest sequence that has room for it, or is exchanged for a shorter one elsewhere,
or two are exchanged for one, whenever this makes the sum of the squared fills grow. Growing
squares pull pieces away from the emptier sequences until these have none left. Moves come first, from
the fullest sequence down, so that short pieces are left to fill the last gaps; then moves and
exchanges, from the emptiest sequence up. For every length of piece, the sequences that are not full
and hold one are kept in order of their room, up to date after every step, and the partner of an
exchange is the fullest that has room for the difference, so gaps are filled closely. The search ends
when no step improves, or when no fewer sequences can hold the pieces. In the first case it starts
again from other orders, ``STARTS`` in all, and the best result stays.

Scale. Texts are encoded where they are read and never moved; only one small row per piece is.
Pieces are dealt to shards of about ``SHARD`` by a number fixed when they were written, so
hot ids or copies cannot gather in one shard, and each shard is packed by itself; the number
of shards follows from the number of pieces. A shard leaves at most a few sequences underfull.

Nulls: a null text is empty and is one piece of the end id alone. Rows are packed each for
itself, also repeated ones and those without an id. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import keep_table
from forkline.llm.tokens import encoder

CAPACITY = 2048
SHARD = 20_000
#: Orders from which a shard is searched at most.
STARTS = 3


class Bins:
    """Sequences of a shard, each a list of pieces; open ones are found by what is free in them."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = np.asarray(sizes, np.int64).tolist(), capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.open: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0  # bit r: some sequence has r free
        self.items = [[item] for item in range(len(self.sizes))]
        self.fill = list(self.sizes)
        self.used = sum(1 for f in self.fill if f)
        # For each size: open sequences that hold such a piece, by their room, and the most room
        # among them.
        self.holders: list[list[tuple[int, int]]] | None = None
        self.room = np.full(capacity + 1, -1, np.int64)
        self.lengths = np.arange(capacity + 1)
        for at in range(len(self.items)):
            self._reopen(at)

    def _close(self, at: int) -> None:
        """Take a sequence out of those found by their room, while it is worked on."""
        free = self.capacity - self.fill[at]
        self.open[free].discard(at)
        if not self.open[free]:
            self.mask &= ~(1 << free)
        if self.holders is not None and 0 < free < self.capacity:
            for size in {self.sizes[i] for i in self.items[at]}:
                same = self.holders[size]
                place = bisect_left(same, (free, at))
                if place < len(same) and same[place] == (free, at):
                    del same[place]
                    self.room[size] = same[-1][0] if same else -1

    def _reopen(self, at: int) -> None:
        free = self.capacity - self.fill[at]
        if 0 < free < self.capacity:
            self.open[free].add(at)
            self.mask |= 1 << free
            if self.holders is not None:
                for size in {self.sizes[i] for i in self.items[at]}:
                    insort(self.holders[size], (free, at))
                    self.room[size] = self.holders[size][-1][0]

    def _fullest(self, size: int) -> int | None:
        """An open sequence with room for ``size`` and as little more as possible."""
        fitting = self.mask >> size
        if not fitting:
            return None
        return next(iter(self.open[size + (fitting & -fitting).bit_length() - 1]))

    def count(self) -> int:
        return self.used

    def improve(self) -> None:
        """The search from the order of arrival; while sequences could be saved, from other orders too.

        The best of at most ``STARTS`` searches is kept, and none follows one that reaches the
        least number of sequences that can hold the pieces.
        """
        large = sum(1 for size in self.sizes if 2 * size > self.capacity)  # no two of them fit together
        least = max(large, -(-sum(self.sizes) // self.capacity))
        self._climb(least)
        for seed in range(1, STARTS):
            if self.used <= least:
                return
            order = np.random.default_rng(seed).permutation(len(self.sizes))
            other = Bins(np.array(self.sizes)[order], self.capacity)
            other._climb(least)
            if other.used < self.used:
                self.used, self.fill = other.used, other.fill
                self.items = [[int(order[i]) for i in items] for items in other.items]

    def _climb(self, least: int) -> None:
        """Moves and exchanges that raise the sum of squared fills, while there are any and ``least`` is not reached."""
        for step in (self._move, self._improve_once):
            changed = True
            while changed:
                changed = False
                underfull = sorted((b for b in range(len(self.items)) if 0 < self.fill[b] < self.capacity), key=lambda b: (-self.fill[b] if step == self._move else self.fill[b], b))
                if step != self._move and self.holders is None:
                    self.holders = [[] for _ in range(self.capacity + 1)]
                    for b in underfull:
                        self._reopen(b)
                for source in underfull:
                    if self.used <= least:
                        return
                    if not 0 < self.fill[source] < self.capacity:
                        continue
                    self._close(source)
                    while self.fill[source] and step(source):
                        changed = True
                    if not self.fill[source]:
                        self.used -= 1
                    self._reopen(source)

    def _improve_once(self, source: int) -> bool:
        return self._move(source) or self._exchange(source)

    def _move(self, source: int) -> bool:
        """A piece of ``source`` to the fullest sequence that has room for it, longest first."""
        for item in sorted(self.items[source], key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[item]
            target = self._fullest(size)
            if target is not None and self.fill[target] + size > self.fill[source]:
                self._close(target)
                self.items[source].remove(item)
                self.items[target].append(item)
                self.fill[source] -= size
                self.fill[target] += size
                self._reopen(target)
                return True
        return False

    def _exchange(self, source: int) -> bool:
        """One or two pieces of ``source`` for a shorter one elsewhere."""
        by_size: dict[int, list[int]] = defaultdict(list)
        for i in self.items[source]:
            by_size[self.sizes[i]].append(i)
        some = [i for same in by_size.values() for i in same[:2]]  # equal pieces are as good as each other
        groups = [(i,) for i in some] + [(a, b) for n, a in enumerate(some) for b in some[n + 1 :]]
        for group in sorted(groups, key=lambda g: -sum(self.sizes[i] for i in g)):
            total = sum(self.sizes[i] for i in group)
            shortest = max(0, total - self.capacity)
            for size in (np.flatnonzero(self.room[shortest:total] >= total - self.lengths[shortest:total]) + shortest).tolist():
                # The fullest that has room for the difference; if that does not raise the squares, none does.
                target = self.holders[size][bisect_left(self.holders[size], (total - size, -1))][1]
                if self.fill[target] + total - size <= self.fill[source]:
                    continue
                other = next(i for i in self.items[target] if self.sizes[i] == size)
                self._close(target)
                for item in group:
                    self.items[source].remove(item)
                self.items[target].remove(other)
                self.items[target] += group
                self.items[source].append(other)
                self.fill[target] += total - size
                self.fill[source] -= total - size
                self._reopen(target)
                return True
        return False


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its sequence, and its place there."""
    bins = Bins(sizes, capacity)
    bins.improve()
    at, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for number, items in enumerate(bins.items):
        place = 0
        for item in items:
            at[item], offset[item] = number, place
            place += bins.sizes[item]
    return at, offset


def _pieces_of(path: str, capacity: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoder(path, drops_blanks=True)
        for batch in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for n, ids in enumerate(tokens.encode(batch["text"].tolist())):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    which.append(n)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
            keys = batch["key"].to_numpy()[np.array(which, np.int64)]
            yield pd.DataFrame({"key": keys, "piece": np.array(piece, np.int32), "start": start, "length": length, "ids_crc32": crc})

    return rows


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every text, in a table of its own."""
    rows = docs.select(F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text"))
    cut = rows.mapInPandas(_pieces_of(path, capacity), "key string, piece int, start bigint, length bigint, ids_crc32 bigint")
    kind = docs.schema[doc_id].dataType
    numbered = cut.select(F.col("key").cast(kind).alias("doc_id"), "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("number"))
    return keep_table(docs.sparkSession, numbered, "pieces")


def _packed_shard(capacity: int):
    def rows(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("number", kind="stable").reset_index(drop=True)
        at, offset = pack(shard["length"].to_numpy(), capacity)
        shard["sequence_id"] = shard["shard"].astype("int64") * (1 << 32) + at
        shard["offset"] = offset
        return shard[["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return rows


def best_fit(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """A row per piece with its sequence and its place there."""
    pieces = token_pieces(docs, path, doc_id, text, capacity)
    kind = pieces.schema["doc_id"].dataType
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards))).withColumn("doc_id", F.col("doc_id").cast("string")).withColumnRenamed("doc_id", "key")
    schema = "key string, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    packed = dealt.groupBy("shard").applyInPandas(_packed_shard(capacity), schema)
    return packed.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", "doc_id")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return best_fit(docs, tokenizer_path("word_bpe_49k.json"))
