"""Exact top-k search by inner product, pruned block by block.

Vectors are whole numbers (scaled and floored). Their components are the terms. A block is a run
of up to ``BLOCK`` rows of one task: its forward index (all components of its vectors, row by
row, in the narrowest integer type that holds them) with the greatest and least value of every
component. For a query, the sum over components of query value times greatest (or, where the
query is negative, least) value bounds every score of the block from above.

A task holds some blocks and a chunk of queries. Per query, blocks are ordered by their bounds
and scored through their forward index in waves of 1, 2, 4, ... blocks; after each wave the k-th
score so far rises. A block whose bound is below it is passed over; once the next block's bound
is, so are all that follow. Blocks that tie with the k-th score are scored, as ties go to the
smaller id.

Queries are taken in chunks of at most ``CHUNK`` rows and ``CELLS`` components, which bounds what
is broadcast and what reaches the driver at a time, however many there are. Each chunk meets all
blocks in two jobs: first one block in ``FIRST`` of every task, which gives each query a true lower
bound of its k-th score, then all the others, of which few scores are left to be shuffled.
Vectors are stored once, narrow, and never shuffled; only scores are. Results are the same
whatever the order of rows or tasks.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without
an id. Of vectors of different lengths the shorter one counts as filled up with zeros; an empty
one scores zero. A row is no candidate of its own query; other rows of the same id are, and each
row that repeats a query is a query of its own. Fewer than ``k`` candidates are all returned. An
empty table gives an empty result. Scaled components beyond 2**62, and scores beyond a long, are
errors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forkline.llm.common import keep_table
from forkline.session import scratch_root

K, SCALE, EVERY = 20, 64, 20
BLOCK, FIRST, GROUP = 256, 16, 512
CHUNK, CELLS = 1 << 14, 1 << 22
#: Scores a task holds before it reduces them to the best k of each query.
POOL = 1 << 21
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("first", pa.bool_()), ("dims", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary()), ("high", pa.binary()), ("low", pa.binary())])
BLOCK_DDL = "block bigint, first boolean, dims bigint, width int, ids binary, cells binary, high binary, low binary"
FOUND_DDL = "q int, query_id bigint, vec_id bigint, score bigint"


def _packed(cells: np.ndarray) -> tuple[int, bytes]:
    """The narrowest width that holds all values, and their bytes."""
    most = max(int(cells.max()), -int(cells.min()) - 1) if cells.size else 0
    width = next(i for i, t in enumerate(WIDTHS) if most <= np.iinfo(t).max)
    return width, cells.astype(WIDTHS[width]).tobytes()


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of equal length, numbered within the task."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    held: dict[int, int] = {}
    base, made = TaskContext.get().partitionId() << 32, 0

    def emit(ids: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        nonlocal made
        width, data = _packed(cells)
        ends = [cells.max(axis=0), cells.min(axis=0)]
        row = [base + made, made % FIRST == 0, cells.shape[1], width, ids.astype("<i8").tobytes(), data, *[e.astype(WIDTHS[width]).tobytes() for e in ends]]
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)

    for batch in batches:
        lists = batch.column("v")
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
        if len(values) and np.abs(values).max() >= 2.0**62:
            raise ValueError("a scaled component is beyond 2**62")
        values, ids = values.astype(np.int64), batch.column("vec_id").to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dims)
            cells = values[starts[rows][:, None] + np.arange(dims)[None, :]]
            waiting.setdefault(dims, []).append((ids[rows], cells))
            held[dims] = held.get(dims, 0) + len(rows)
            size = max(1, min(block, (1 << 20) // max(dims, 1)))
            if held[dims] >= size:
                ids_of, cells_of = (np.concatenate(c) for c in zip(*waiting[dims]))
                whole = len(ids_of) - len(ids_of) % size
                for a in range(0, whole, size):
                    yield emit(ids_of[a : a + size], cells_of[a : a + size])
                waiting[dims], held[dims] = [(ids_of[whole:], cells_of[whole:])], len(ids_of) - whole
        if sum(d * n for d, n in held.items()) > 1 << 23:  # many lengths: close what is open
            for dims in list(waiting):
                ids_of, cells_of = (np.concatenate(c) for c in zip(*waiting.pop(dims)))
                held.pop(dims)
                if len(ids_of):
                    yield emit(ids_of, cells_of)
    for dims in list(waiting):
        ids_of, cells_of = (np.concatenate(c) for c in zip(*waiting.pop(dims)))
        if len(ids_of):
            yield emit(ids_of, cells_of)


def block_table(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """The blocks of all vectors that take part, in the shared folder."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    return keep_table(table.sparkSession, good.mapInArrow(lambda it: _blocks(it, scale, block), BLOCK_DDL), "blocks")


class Block:
    """One block, out of a row of the table."""

    def __init__(self, row: dict):
        kind = np.dtype(WIDTHS[row["width"]])
        self.number, self.dims = row["block"], row["dims"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.cells = np.frombuffer(row["cells"], kind).reshape(len(self.ids), self.dims)
        self.high, self.low = np.frombuffer(row["high"], kind), np.frombuffer(row["low"], kind)


class Queries:
    """A chunk of query vectors of equal length: ids, values, and the row each one is."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, blocks: np.ndarray, places: np.ndarray):
        self.ids, self.values, self.blocks, self.places = ids, values, blocks, places


def _kind(queries: np.ndarray, blocks: list[Block]) -> type:
    """The type in which all products are exact: double while they are below 2**53, else whole numbers."""
    most = max((max(abs(int(b.high.max())), abs(int(b.low.min()))) for b in blocks if b.high.size), default=0)
    bound = most * int(np.abs(queries).max(initial=0)) * max(queries.shape[1], 1)
    if bound >= 1 << 63:
        raise ValueError("scores may not fit a long")
    return np.float64 if bound < 1 << 53 else np.int64


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of each query: highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, q))
    sorted_q = q[order]
    start = np.searchsorted(sorted_q, sorted_q)
    return order[np.arange(len(order)) - start < k]


def search(blocks: list[Block], queries: Queries, least: np.ndarray, k: int = K, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, ids and scores: of these blocks, the best k of each query from ``least`` on.

    ``least`` is a lower bound of each query's k-th score over the whole table. ``scored``
    collects how many pairs of query and vector were scored.
    """
    n, empty = len(queries.ids), np.zeros(0, np.int64)
    found = (empty, empty, empty)
    if not n or not blocks:
        return found
    kind = _kind(queries.values, blocks)
    values = queries.values.astype(kind)
    up, down = np.maximum(values, 0), np.minimum(values, 0)
    limit = least.copy()
    bounds = np.empty((n, len(blocks)), np.int64)
    for j, b in enumerate(blocks):
        d = min(b.dims, values.shape[1])
        bounds[:, j] = up[:, :d] @ b.high[:d].astype(kind) + down[:, :d] @ b.low[:d].astype(kind)
    order = np.argsort(-bounds, axis=1, kind="stable")
    ranked = np.take_along_axis(bounds, order, axis=1)
    pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def settle() -> None:
        nonlocal found, pool, waiting
        q, ids, scores = (np.concatenate(c) for c in zip(found, *pool))
        best = _best(q, ids, scores, k)
        found, pool, waiting = (q[best], ids[best], scores[best]), [], 0
        full = np.flatnonzero(np.bincount(found[0], minlength=n) >= k)
        kth = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(kth, found[0], found[2])
        limit[full] = np.maximum(limit[full], kth[full])

    at, width = 0, 1
    while at < len(blocks):
        wave = slice(at, at + width)
        # Bounds fall along a row: where the first of the wave is below the limit, all that follow are.
        rows = np.flatnonzero(ranked[:, at] >= limit)
        if not len(rows):
            break
        member, nth = np.nonzero(ranked[rows, wave] >= limit[rows, None])
        wanted = order[rows[member], at + nth]
        by_block = np.argsort(wanted, kind="stable")
        numbers, starts = np.unique(wanted[by_block], return_index=True)
        for j, group in zip(numbers.tolist(), np.split(rows[member[by_block]], starts[1:])):
            b = blocks[j]
            sel = group[bounds[group, j] >= limit[group]]
            d = min(b.dims, values.shape[1])
            scores = (values[sel, :d] @ b.cells[:, :d].astype(kind).T).astype(np.int64)
            own = np.flatnonzero(queries.blocks[sel] == b.number)
            if scored is not None:
                scored.append(scores.size - len(own))
            ok = scores >= limit[sel, None]
            if scores.shape[1] > k + 1:  # one place more, as the query's own row may be among them
                ok &= scores >= np.partition(scores, -k - 1, axis=1)[:, [-k - 1]]
            ok[own, queries.places[sel[own]]] = False
            a, c = np.nonzero(ok)
            pool.append((sel[a], b.ids[c], scores[a, c]))
            waiting += len(a)
            if waiting > POOL:
                settle()
        settle()
        at, width = at + width, 2 * width
    return found


def query_chunks(blocks: DataFrame, every: int = EVERY, chunk: int = CHUNK, cells: int = CELLS) -> Iterator[Queries]:
    """The vectors whose id is a multiple of ``every``, in chunks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                places = np.flatnonzero(b.ids % every == 0)
                if len(places):
                    row = [b.number, b.dims, b.ids[places].tobytes(), places.astype("<i8").tobytes(), b.cells[places].astype("<i8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["block", "dims", "ids", "places", "cells"])

    rows = blocks.select("block", "dims", "width", "ids", "cells", "high", "low").mapInArrow(run, "block bigint, dims bigint, ids binary, places binary, cells binary")
    table = keep_table(blocks.sparkSession, rows, "queries")
    for dims in [r["dims"] for r in table.select("dims").distinct().orderBy("dims").toLocalIterator()]:
        kept: list[tuple[np.ndarray, ...]] = []
        size = 0
        most = max(1, min(chunk, cells // max(dims, 1)))
        for r in table.filter(F.col("dims") == dims).toLocalIterator():
            ids, places = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["places"], "<i8")
            values = np.frombuffer(r["cells"], "<i8").reshape(len(ids), dims)
            for a in range(0, len(ids), most):
                part = slice(a, a + most)
                if size + len(ids[part]) > most:
                    yield Queries(*(np.concatenate(c) for c in zip(*kept)))
                    kept, size = [], 0
                kept.append((ids[part], values[part], np.full(len(ids[part]), r["block"]), places[part]))
                size += len(ids[part])
        if kept:
            yield Queries(*(np.concatenate(c) for c in zip(*kept)))


def _candidates(blocks: DataFrame, queries: Queries, least: np.ndarray, k: int) -> DataFrame:
    """q (place in the chunk), query_id, vec_id and score: each task's best of each query."""
    given = blocks.sparkSession.sparkContext.broadcast((queries, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, limit = given.value
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                held = [Block(row) for row in batch.slice(start, GROUP).to_pylist()]
                q, ids, scores = search(held, chunk, limit, k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(chunk.ids[q]), pa.array(ids), pa.array(scores)], ["q", "query_id", "vec_id", "score"])

    return blocks.select("block", "dims", "width", "ids", "cells", "high", "low").mapInArrow(run, FOUND_DDL)


def _top(found: DataFrame, k: int) -> DataFrame:
    ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k)


def top_k(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` best of every query, over all rows."""
    spark = table.sparkSession
    blocks = block_table(table, vector, vec_id, scale, block)
    path = f"{scratch_root(spark).rstrip('/')}/forkline-topk-{uuid.uuid4().hex}"
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    for queries in query_chunks(blocks, every, chunk):
        unknown = np.full(len(queries.ids), np.iinfo(np.int64).min)
        first = keep_table(spark, _top(_candidates(blocks.filter("first"), queries, unknown, k), k), "topk-first")
        least = unknown.copy()
        for r in first.filter(F.col("rank") == k).select("q", "score").collect():  # at most one row per query of the chunk
            least[r["q"]] = r["score"]
        rest = _candidates(blocks.filter("NOT first"), queries, least, k)
        both = first.select("q", "query_id", "vec_id", "score").unionByName(rest)
        _top(both, k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op11_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.n, q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM v q JOIN v ON v.n <> q.n WHERE q.vec_id % {EVERY} = 0 AND v.vec_id IS NOT NULL
)
SELECT query_id, (row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= {K}
"""
