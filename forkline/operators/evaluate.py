"""Result comparison, database lookup and execution accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.functions.prompts import prompt_fields

#: Rows counted in a task, and rows beyond which more than ``UNHELD_PARTITIONS`` are made, which is
#: Spark's own ``spark.shuffle.sort.bypassMergeThreshold``.
COUNTED_ROWS, MOST_COUNTED, UNHELD_PARTITIONS = 250_000, 2_000_000, 200


def require(condition: Column, message: str) -> Column:
    """A filter that keeps every row and fails the job where ``condition`` is not true."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def _sign() -> Column:
    return F.when(F.col("side") == "pred", 1).otherwise(-1)


def row_hashes(vals: Column) -> list[Column]:
    """Two 64-bit hashes of a row of values.

    A hash skips nulls, so every value is marked: null and the empty text differ, as do a null
    row and an empty one.
    """
    marked = F.transform(vals, lambda v: F.coalesce(F.concat(F.lit("="), v), F.lit("")))
    size = F.coalesce(F.size(vals), F.lit(-1))
    return [F.xxhash64(F.lit(lane), size, marked) for lane in (1, 2)]


def compare_results(result_rows: DataFrame) -> DataFrame:
    """``index, same_rows`` for every index that has rows on either side.

    Multiset equality by additive fingerprints: row order is free, column order and repeats
    count, null equals null.  Both sides have equal numbers of rows and equal sums of either
    hash, exact sums over all rows.  Results that differ pass for equal with a chance of about
    2 to the power of -128 per index.  The sums are combined before the one shuffle, so an index with
    very many rows moves one small row per task.
    """
    lanes = [(_sign() * h.cast("decimal(20,0)")) for h in row_hashes(F.col("vals"))]
    sums = [F.sum(_sign()).alias("_n"), *[F.sum(lane).alias(f"_h{i}") for i, lane in enumerate(lanes)]]
    alike = (F.col("_n") == 0) & (F.col("_h0") == 0) & (F.col("_h1") == 0)
    return result_rows.groupBy("index").agg(*sums).select("index", alike.alias("same_rows"))


def counting_partitions(n_rows: int) -> int:
    """How many partitions rows are counted in: some ``COUNTED_ROWS`` in each, up to the number of
    files a shuffle writes without holding its rows in memory, then ``MOST_COUNTED`` in each."""
    return max(min(-(-n_rows // COUNTED_ROWS), UNHELD_PARTITIONS), -(-n_rows // MOST_COUNTED), 1)


def surplus_rows(result_rows: DataFrame) -> DataFrame:
    """``index, side, vals, n_rows``: what one side has more often than the other, and how
    much more often.  Indexes whose results agree have no row here.

    All rows are counted exactly, by (index, vals), which spreads an index with very many rows
    over all tasks.  They move once, uncombined, to as many partitions as their number asks for:
    a task that combines first holds nearly all rows of its part of a file, and adaptive execution
    joins partitions by compressed bytes, a tenth of what counting them takes.  A row that repeats
    very often passes through one task, where it takes the room of one row.
    """
    dealt = result_rows.repartition(counting_partitions(result_rows.count()), "index", "vals")
    surplus = dealt.groupBy("index", "vals").agg(F.sum(_sign()).alias("_surplus"))
    return surplus.filter(F.col("_surplus") != 0).select(
        "index",
        F.when(F.col("_surplus") > 0, "pred").otherwise("gold").alias("side"),
        "vals",
        F.abs("_surplus").alias("n_rows"),
    )


def judge_runs(result_rows: DataFrame, status: DataFrame) -> DataFrame:
    """``status`` with ``exec_match`` and ``error``.

    ``status`` says which runs failed; an index without rows on both sides matches, as
    empty equals empty, unless a run failed.
    """
    same = F.coalesce(F.col("same_rows"), F.lit(True))
    failed = F.coalesce(F.col("pred_error"), F.col("gold_error"))
    return (
        status.join(compare_results(result_rows), "index", "left")
        .withColumns(
            {
                "exec_match": failed.isNull() & same,
                "error": F.coalesce(failed, F.when(~same, F.lit("results differ"))),
            }
        )
        .drop("same_rows")
    )


def exec_match(result_rows: DataFrame, status: DataFrame) -> DataFrame:
    """``index, exec_match, error`` for every row of ``status``."""
    return judge_runs(result_rows, status).select("index", "exec_match", "error")


def align_gold(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Join gold and predictions on ``index``; an unmatched row on either side fails.

    The full outer join is what makes a missing row visible.
    """
    g = gold.withColumn("_in_gold", F.lit(True))
    p = predictions.withColumn("_in_pred", F.lit(True))
    both = F.col("_in_gold").isNotNull() & F.col("_in_pred").isNotNull()
    return (
        g.join(p, "index", "full")
        .filter(require(both, "gold and predictions differ in length"))
        .drop("_in_gold", "_in_pred")
    )


def join_divergences(exec_results: DataFrame, divergences: DataFrame) -> DataFrame:
    """Divergence rows with db_id and exec_match; the gold texts must agree.

    Only the four columns used cross the shuffle on the execution side.
    """
    side = exec_results.select("index", "gold_sql", "db_id", "exec_match")
    return (
        divergences.join(side, "index")
        .filter(require(F.col("gold_sql").eqNullSafe(F.col("label")), "gold text and label differ"))
        .drop("gold_sql")
    )


def failed_rows(exec_results: DataFrame) -> DataFrame:
    """Everything that is not known to match, null included."""
    return exec_results.filter(~F.col("exec_match").eqNullSafe(True))


def strictly_failed(exec_results: DataFrame) -> DataFrame:
    return exec_results.filter(~F.col("exec_match"))


def strictly_passed(exec_results: DataFrame) -> DataFrame:
    return exec_results.filter(F.col("exec_match"))


def attach_db_id(rows: DataFrame, train_map: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; a row without a database stays, with an error.

    ``train_map`` holds one row per key and grows with the training data, so no
    broadcast is forced: adaptive execution picks one by measured size, and otherwise
    splits a key that many rows share.
    """
    lookup = train_map.select(F.col("key").alias("_key"), "db_id")
    return (
        rows.withColumn("_key", F.col(key).cast("string"))
        .join(lookup, "_key", "left")
        .withColumn(
            "lookup_error", F.when(F.col("db_id").isNull(), F.lit("no database id"))
        )
        .drop("_key")
    )


def exec_projection(predictions: DataFrame, gold: str) -> DataFrame:
    """The evaluation row of a prediction, before anything has run."""
    fields = prompt_fields(F.coalesce(F.col("prompt"), F.lit("")))
    return (
        predictions.withColumn("_fields", fields)
        .withColumns(
            {
                "exec_match": F.lit(False),
                "error": F.lit(None).cast("string"),
                "gold_sql": F.col(gold),
                "schema": F.col("_fields.schema"),
                "nl": F.col("_fields.nl"),
            }
        )
        .drop("_fields")
    )


def evaluate_runs(looked_up: DataFrame, result_rows: DataFrame, status: DataFrame) -> DataFrame:
    """Outcome per sample: exec_match, error and one flag per counter.

    No database: counted and done.  Gold text not parsed: counted and done.  Prediction
    not parsed: counted, but the run is still compared, and its error stays unless the
    comparison has one of its own.
    """
    rows = looked_up.join(judge_runs(result_rows, status), "index", "left")
    no_db = F.col("db_id").isNull()
    gold_bad = ~no_db & F.col("gold_parse_error").isNotNull()
    pred_bad = ~no_db & ~gold_bad & F.col("pred_parse_error").isNotNull()
    runs = ~no_db & ~gold_bad
    no_run = runs & F.col("exec_match").isNull()
    return rows.select(
        *looked_up.columns,
        (runs & F.coalesce("exec_match", F.lit(False))).alias("exec_match"),
        F.when(no_db, F.col("lookup_error"))
        .when(gold_bad, F.col("gold_parse_error"))
        .when(no_run, F.lit("not run"))
        .otherwise(F.coalesce("error", "pred_parse_error"))
        .alias("error"),
        no_db.alias("no_db_id"),
        (gold_bad | pred_bad).alias("parse_error"),
        no_run.alias("exec_error"),
    ).drop("lookup_error")


def accuracy(outcomes: DataFrame) -> DataFrame:
    """One row of counters; the percentage of an empty table is null."""
    correct = F.count_if("exec_match")
    return outcomes.agg(
        F.count("*").alias("total"),
        correct.alias("exec_correct"),
        F.round(F.try_divide(correct * F.lit(100.0), F.count("*")), 2).alias("accuracy_pct"),
        F.count_if("no_db_id").alias("no_db_id"),
        F.count_if("parse_error").alias("parse_error"),
        F.count_if("exec_error").alias("exec_error"),
    )
