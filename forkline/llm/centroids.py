"""Centroid clustering of whole-number vectors, with exact nearest-centroid search.

Components are scaled and floored to whole numbers, so sums, means (floored) and squared
distances are exact and the result is the same whatever the order of rows or tasks.

Search. Centroids are sorted by their component sum, that is by their mean. A vector starts at
its own mean and goes outward, always to the nearer of the next centroid below and above. With d
components, S the sums and V the deviations (lengths after the mean is taken off), the squared
distance is at least (Sx - Sc)^2 / d + (Vx - Vc)^2. Once the first term alone exceeds the least
distance found, all centroids further out are rejected with it; a centroid whose two terms exceed
it is passed over. Both comparisons have a margin far above their rounding error, so nothing is
rejected wrongly, ties included. What is left is decided by the exact distance in whole numbers,
ties to the smaller number.

Each round every task emits one partial sum per centroid; ``k`` rows of totals reach the driver,
which divides them. Centroids go to the tasks as part of the function. Vectors are neither moved
nor stored.

Vectors that are null, hold a null or non-finite component or have other than ``dims`` components
take no part; a null id hashes as an empty one. Of equal hashes the smaller vector comes first.
Repeated rows count each. Fewer than ``k`` vectors give as many centroids; none, an empty result.
Scaled components of 2**27 or more in size are an error, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import keep_table

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
LIMIT = 1 << 27
#: Vectors that a task searches at once.
ROWS = 4096


class Centroids:
    """Centroids in the order of their sums."""

    def __init__(self, vectors: np.ndarray):
        sums = vectors.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.vectors, self.sums = vectors[self.number], sums[self.number]
        self.squares, self.spread = _spread(self.vectors, self.sums)


def _spread(vectors: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths, and deviations from the mean."""
    squares = np.einsum("ij,ij->i", vectors, vectors).astype(float)
    means = sums.astype(float) ** 2 / max(vectors.shape[1], 1)
    return squares, np.sqrt(np.maximum(squares - means, 0))


def nearest(x: np.ndarray, centroids: Centroids, tested: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance of every row of ``x``.

    ``tested`` collects how many distances were computed.
    """
    n, dims = x.shape
    k = len(centroids.sums)
    sums = x.sum(axis=1)
    squares, spread = _spread(x, sums)
    high = np.searchsorted(centroids.sums, sums)
    low = high - 1
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    # Sums lie within dims * 2**27, so this exceeds every true gap and its square fits.
    far = np.int64(1 << 30) * max(dims, 1)
    alive = np.arange(n)
    while len(alive):
        lo, hi = low[alive], high[alive]
        below = np.where(lo >= 0, sums[alive] - centroids.sums[np.maximum(lo, 0)], far)
        above = np.where(hi < k, centroids.sums[np.minimum(hi, k - 1)] - sums[alive], far)
        gap = np.minimum(below, above)
        goes = (gap < far) & (gap.astype(float) ** 2 / max(dims, 1) <= best[alive] * (1 + 1e-9) + 1)
        alive, up = alive[goes], (above < below)[goes]
        gap, at = gap[goes], np.where(up, hi[goes], lo[goes])
        high[alive[up]] += 1
        low[alive[~up]] -= 1
        bound = gap.astype(float) ** 2 / max(dims, 1) + (spread[alive] - centroids.spread[at]) ** 2
        margin = 1e-7 * (squares[alive] + centroids.squares[at]) + 1
        left = bound - margin <= best[alive]
        rows, at = alive[left], at[left]
        if tested is not None:
            tested.append(len(rows))
        apart = x[rows] - centroids.vectors[at]
        distance = np.einsum("ij,ij->i", apart, apart)
        number = centroids.number[at]
        better = (distance < best[rows]) | ((distance == best[rows]) & (number < who[rows]))
        best[rows[better]], who[rows[better]] = distance[better], number[better]
    return who, best


def kept_vectors(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", dims: int = DIMS) -> DataFrame:
    """vec_id and v, as doubles, of the vectors that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") == dims) & ~F.exists("v", bad))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            values = np.floor(scale * part.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
            if len(values) and np.abs(values).max() >= LIMIT:
                raise ValueError(f"a scaled component is {LIMIT} or more")
            yield part.column("vec_id"), values.astype(np.int64)


def first_centroids(vectors: DataFrame, k: int = K, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    whole: Column = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x))
    rows = vectors.select(digest.alias("h"), whole.alias("w")).orderBy("h", "w").limit(k).collect()
    return np.array([r["w"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The centroids after one round: floored means of their vectors; empty ones stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Centroids(centroids)
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x in _matrices(batches, dims, scale):
            who, _ = nearest(x, of)
            order = np.argsort(who, kind="stable")
            found, starts = np.unique(who[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], starts, axis=0) if len(x) else 0
            counts += np.bincount(who, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(counts[some]), "sums": pa.array(list(sums[some]), pa.list_(pa.int64()))})

    partial = vectors.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    totals = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    new = centroids.copy()
    for row in totals.collect():
        new[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return new


def assigned(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Centroids(centroids)
        for ids, x in _matrices(batches, centroids.shape[1], scale):
            who, distance = nearest(x, of)
            yield pa.RecordBatch.from_arrays([ids, pa.array(who, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every vector that takes part, and the centroids."""
    vectors = kept_vectors(table, vector, vec_id, dims)
    centroids = first_centroids(vectors, k, scale, seed)
    if not len(centroids):
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), centroids.reshape(0, dims)
    for _ in range(rounds):
        centroids = moved(vectors, centroids, scale)
    return keep_table(table.sparkSession, assigned(vectors, centroids, scale), "assigned"), centroids


def with_inertia(members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Members with the summed distance of their cluster and of all, and the centroid's digest.

    The joined table has one row per centroid, which bounds its broadcast.
    """
    spark = members.sparkSession
    sums = {r["cluster"]: r["s"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, total, digests[c]) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "of_cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return members.join(F.broadcast(facts), F.col("cluster") == F.col("of_cluster")).drop("of_cluster")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(members, centroids)


def _rounds_sql() -> str:
    away = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.n, min([{away}::BIGINT, c.k::BIGINT]) AS best FROM v CROSS JOIN c{r} c GROUP BY v.n)")
        if r < ROUNDS:
            steps.append(f"""t{r} AS MATERIALIZED (SELECT a.best[2] AS k, i, sum(v.e[i]) AS s, count(*) AS m FROM a{r} a JOIN v USING (n), range(1, {DIMS} + 1) r(i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT k, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS e FROM t{r} GROUP BY k
  UNION ALL SELECT k, e FROM c{r} WHERE k NOT IN (SELECT k FROM t{r}))""")
    return ",\n".join(steps)


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS k, e FROM v QUALIFY k < {K}),
{_rounds_sql()},
members AS (SELECT vec_id, best[2] AS cluster, best[1] AS distance FROM a{ROUNDS} JOIN v USING (n))
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM members JOIN c{ROUNDS} c ON c.k = members.cluster
"""
