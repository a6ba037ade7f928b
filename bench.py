"""Wall time of the headline queries: one JSON line on standard output.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts.
Results go to Spark's noop sink, so every row and column is computed and none is kept.
The given tables are single files of one row group, which no reader can share among tasks,
so they are first written once as a file per core, as any large table would lie; this is
not timed. With ``BENCH_DUCKDB=1`` the checking SQL is timed beside it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from forkline.plans import all_queries, oracles
from forkline.session import local_session

HEADLINE = (
    "divergence_profile",
    "normalize_pairs",
    "divergence_detail",
    "compare_pairs",
    "sql_tokens",
    "document_divergence",
    "document_token_divergence",
    "exec_match",
    "accuracy",
    "class_sizes",
    "split_sets",
    "pair_by_retain",
    "seeded_rank",
    "encode_samples",
    "batch_pad",
    "unlearn_loss",
    "step_topk",
    "mean_pool",
    "cosine_pairs",
)

TABLES = ("orders", "lineitem", "customer", "documents", "labels", "pages", "embeddings", "conversations")


def timed(query, spark, sf: str) -> float:
    start = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def laid_out(spark, sf: str, cores: int) -> str:
    """The tables the queries read, each in as many files as there are cores."""
    target = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(cores).write.parquet(f"{target}/{name}.parquet")
    return target


def duckdb_seconds(names, sf: str, cores: int) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": cores})
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    seconds = {}
    for name in names:
        start = time.perf_counter()
        con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {oracles()[name]}")
        seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, app="bench", spark__ui__showConsoleProgress="false")
    queries = all_queries()
    seconds: dict[str, float] = {}
    tables = laid_out(spark, sf, cores)
    for name in names:
        timed(queries[name], spark, tables)
        median = statistics.median(timed(queries[name], spark, tables) for _ in range(runs))
        seconds[name] = round(median, 3)
    spark.stop()
    report = {
        "metric": "total wall time, warm median per query",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf,
    }
    if os.environ.get("BENCH_DUCKDB") == "1":
        report["duckdb"] = duckdb_seconds(names, sf, cores)
    print(json.dumps(report))


if __name__ == "__main__":
    main()
