"""What the physical plans must and must not hold."""

import ast
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from forkline.operators import classify, evaluate, losses, sampling, scores
from forkline.plans import all_queries, fixtures as fx

WRITING = {"json_array_splits", "land_rejects", "incremental_rejects", "class_files_rerun", "json_array_scan", "incremental_resume", "jsonl_roundtrip", "jsonl_tolerant", "class_files", "incremental_divergences", "summary_file"}


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", sorted(set(all_queries()) - WRITING))
def test_no_python_and_no_cross_join(spark, small, name):
    text = plan(all_queries()[name](spark, small))
    for bad in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_text_work_is_narrow(spark, small):
    """Normalising, diverging and comparing pairs adds no shuffle to the scan."""
    from forkline.operators.clauses import compare_pairs
    from forkline.operators.diverge import diverge
    from forkline.operators.normalize import normalize_pairs

    orders = spark.sql(fx.SQL_PAIRS, orders=fx.table(spark, small, "orders"))
    for df in (diverge(normalize_pairs(orders)), compare_pairs(orders)):
        assert "Exchange" not in plan(df)


def test_scans_read_few_columns(spark, small):
    text = plan(evaluate.failed_rows(fx.exec_rows(spark, small)).select("index"))
    scan = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert "o_totalprice" not in scan and "o_custkey" not in scan


def test_top_k_is_cut_before_the_shuffle(spark, small):
    text = plan(scores.step_topk(fx.step_scores(spark, small)))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_losses_need_no_join(spark, small):
    text = plan(losses.unlearn_loss(fx.derived(spark, small, fx.TOKEN_LOSS)))
    assert "Join" not in text and text.count("partial_") > 0


def test_nothing_insists_on_a_broadcast(spark, small):
    df = fx.exec_rows(spark, small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = plan(sampling.split_sets(df, 10, 10))
        other = plan(
            classify.class_flags(
                evaluate.failed_rows(evaluate.join_divergences(df, fx.divergence_rows(spark, small))),
                fx.token_vectors(spark, small),
            )
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" not in split and "BroadcastExchange" not in other


def test_class_features_are_computed_once(spark, small):
    """Three uses of the features read what was stored; no text work is left in the plan."""
    rows = evaluate.failed_rows(evaluate.join_divergences(fx.exec_rows(spark, small), fx.divergence_rows(spark, small)))
    text = plan(classify.class_flags(rows, fx.token_vectors(spark, small)))
    assert "regexp_extract_all" not in text and "o_custkey" not in text


def test_positions_do_not_move_the_rows(spark, small):
    from forkline.sources.tables import with_position

    text = plan(with_position(spark.read.parquet(f"{small}/lineitem.parquet")))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_hot_key_results_are_whole(spark):
    """A third of all rows under one key: the same results as by hand."""
    n = 3000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("index"),
        F.array((F.col("id") % 5).cast("string")).alias("vals"),
    )
    both = rows.withColumn("side", F.explode(F.array(F.lit("pred"), F.lit("gold"))))
    assert evaluate.compare_results(both).filter(~F.col("same_rows")).count() == 0
    odd = both.unionByName(spark.createDataFrame([(7, ["x"], "pred")], "index long, vals array<string>, side string"))
    assert [r["index"] for r in evaluate.compare_results(odd).filter(~F.col("same_rows")).collect()] == [7]


def test_no_local_checkpoint_and_no_collect():
    root = pathlib.Path(__file__).resolve().parent.parent / "forkline"
    for path in (p for p in root.rglob("*.py") if "llm" not in p.parts):
        calls = {
            node.func.attr
            for node in ast.walk(ast.parse(path.read_text(encoding="utf-8")))
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute)
        }
        assert not calls & {"localCheckpoint", "collect", "toPandas", "crossJoin", "foreach"}, path


def test_offsets_meet_by_range(spark, small):
    """Only sums over ranges of buckets reach a window without partitions."""
    keys = spark.range(1000).withColumnRenamed("id", "index")
    text = plan(sampling.seeded_rank(keys, "index", 1, bucket_rows=10))
    windows = [line for line in text.splitlines() if line.startswith("Arguments: [") and "windowspecdefinition" in line]
    by_bucket = [w for w in windows if "windowspecdefinition(_t" in w and "_b#" in w]
    alone = [w for w in windows if w.rstrip().endswith("ASC NULLS FIRST]") and w.count("], [") == 1]
    assert by_bucket and alone and all("_t#" in w and "_b#" not in w for w in alone)


@pytest.mark.parametrize("bucket_rows", [1, 7, 100_000])
def test_ranks_are_those_of_one_sort(spark, bucket_rows):
    import hashlib

    keys = [(i,) for i in range(700)]
    df = spark.createDataFrame(keys, "index long").repartition(4)
    order = sorted((hashlib.md5(f"5:{i}".encode()).hexdigest(), i) for (i,) in keys)
    expected = sorted((i, n) for n, (_, i) in enumerate(order))
    assert sorted((r["index"], r["rank"]) for r in sampling.seeded_rank(df, "index", 5, bucket_rows=bucket_rows).collect()) == expected
    few = sampling.seeded_rank(df, "index", 5, upto=33, bucket_rows=bucket_rows).collect()
    assert sorted((r["index"], r["rank"]) for r in few) == [x for x in expected if x[1] < 33]
    assert sampling.seeded_rank(df.limit(0), "index", 5, bucket_rows=bucket_rows).count() == 0


def test_padding_moves_no_arrays(spark, small):
    from forkline.operators import masks

    arrays = [F.array(F.col("l_orderkey").cast("int")).alias(c) for c in masks.PADDING]
    rows = fx.table(spark, small, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("index"), *arrays)
    text = plan(masks.batch_pad(rows, 8, 0))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text
    padded = masks.batch_pad(rows, 8, 0)
    assert padded.filter(F.size("input_ids") != 1).count() == 0 and padded.count() == rows.count()


def test_results_are_compared_with_one_shuffle(spark, small):
    assert plan(evaluate.compare_results(fx.result_rows(spark, small))).count(") Exchange") == 1


def test_bucketed_tables_meet_where_they_lie(spark, small):
    from forkline.sources.tables import bucketed

    rows = fx.exec_rows(spark, small)
    sides = [bucketed(rows.select("index", c), c, buckets=4) for c in ("predict", "label")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        aligned = evaluate.align_gold(*sides)
        text = plan(aligned)
        assert "Exchange" not in text and "SortMergeJoin" in text
        assert aligned.count() == rows.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_landing_reads_its_file_once(spark, tmp_path):
    from forkline.sources import tables

    (tmp_path / "x.jsonl").write_text('{"index": 1}\n{')
    parsed, bad = tables.parsed_lines(spark.read.text(str(tmp_path / "x.jsonl")), "predictions")
    assert plan(parsed.withColumn("rejected", bad)).count("Scan text") <= 2  # tree and detail of one scan


def test_lengths_of_batches_build_no_masks(spark, small):
    """What goes into the maxima of a batch reads ids only, not the masks made from them."""
    from forkline.operators import masks
    from forkline.plans import training_queries as tq

    samples = tq._samples(spark, small)
    rows = masks.encode_samples(samples, [-7, -8])
    fields = F.struct(*[c for c in samples.columns if c != "index"])
    pairs = masks.build_masks(samples.select("index", fields.alias("forget"), fields.alias("retain")), [-7, -8])
    for df, ids in ((rows, "input_ids"), (pairs, "forget.input_ids"), (pairs, "retain.input_ids")):
        assert "-100" not in plan(df.select(F.size(F.col(ids))))


def test_wide_pairs_are_dealt_to_all_cores(spark, small):
    rows = all_queries()["compare_wide"](spark, small)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_text_work_of_divergences_is_dealt_by_rows(spark, small, monkeypatch):
    """Keys move to all cores before any text is made, and both sides of the join meet there."""
    n_pairs = fx.table(spark, small, "orders").count()
    monkeypatch.setattr(fx, "PAIRS_IN_TASK", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = all_queries()["gold_remainder"](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tasks = -(-n_pairs // 20)
    assert tasks > 4 * spark.sparkContext.defaultParallelism
    assert len(re.findall(rf"Exchange hashpartitioning\(o_orderkey#\d+L, {tasks}\), REPARTITION_BY_NUM", text)) == 2
    assert text.count("Exchange ") == 2
