"""Files, positions, adapters and incremental runs."""

import json

import pytest
from pyspark.sql import functions as F

from forkline.operators.diverge import diverge
from forkline.operators.normalize import normalize_pairs
from forkline.sources import adapters, tables
from forkline.streaming import incremental


def predictions(n, start=0):
    return [{"prompt": "p", "predict": f"SELECT {i}", "label": "SELECT 1"} for i in range(start, start + n)]


def test_json_array_with_positions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(predictions(7), indent=1))
    (tmp_path / "b.json").write_text(json.dumps(predictions(5, 7)))
    rows = tables.read_positioned(spark, "predictions", str(tmp_path), "json_array").collect()
    assert sorted((r["index"], r.predict) for r in rows) == [(i, f"SELECT {i}") for i in range(12)]


def test_positions_over_splits(spark, tmp_path):
    lines = "\n".join(json.dumps(p) for p in predictions(500)) + "\n\n"
    (tmp_path / "x.jsonl").write_text(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = tables.read_positioned(spark, "predictions", str(tmp_path / "x.jsonl"))
        assert rows.rdd.getNumPartitions() >= 1
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["index"], r.predict) for r in got) == [(i, f"SELECT {i}") for i in range(500)]


def test_tolerant_lines(spark, tmp_path):
    good = [json.dumps({"index": i, "predict": "é", "extra": [1]}, ensure_ascii=False) for i in range(3)]
    (tmp_path / "x.jsonl").write_text("\n".join([good[0], '{"index": 9', good[1], "not json", good[2]]) + "\n")
    rows, rejected = tables.read_jsonl_tolerant(spark, "predictions", str(tmp_path / "x.jsonl"))
    assert sorted(r["index"] for r in rows.collect()) == [0, 1, 2]
    assert sorted(r.line for r in rejected.collect()) == ["not json", '{"index": 9']
    assert rejected.count() == 2


def test_json_sink_keeps_null_keys(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "a string, b string")
    tables.write_set(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == '{"a":"é","b":null}\n'
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_set(df, str(tmp_path / "out"))


def test_alias_maps_are_maps(spark, tmp_path):
    row = {"index": 1, "predict_aliases": {"orders": "T1", "b": "x"}, "logits_top5": [{"step": 3, "top5_tokens": ["a"]}]}
    (tmp_path / "d.jsonl").write_text(json.dumps(row))
    got = tables.read_table(spark, "divergences", str(tmp_path / "d.jsonl")).first()
    assert got.predict_aliases == {"orders": "T1", "b": "x"}
    assert got.logits_top5[0].top5_tokens == ["a"] and got.divergence_meta is None


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        adapters.adapt_samples(spark.range(1), "other")
    with pytest.raises(ValueError):
        tables.read_table(spark, "predictions", "x", "csv")


def test_later_text_wins(spark):
    items = spark.createDataFrame(
        [(0, "SELECT\n 1", "a"), (1, " SELECT 1 ", "b"), (2, "SELECT 2", None), (3, None, "c")],
        "index long, query string, db_id string",
    )
    assert [tuple(r) for r in adapters.train_map(items, "query").collect()] == [("SELECT 1", "b")]


def test_incremental_run_resumes(spark, tmp_path):
    src, dst, state = (str(tmp_path / n) for n in ("src", "dst", "state"))
    (tmp_path / "src").mkdir()

    def drop(name, rows):
        lines = "\n".join(json.dumps({"index": i, **r}) for i, r in rows)
        (tmp_path / "src" / name).write_text(lines)

    everything = list(enumerate(predictions(10)))
    drop("a.jsonl", everything[:6])
    incremental.run_incremental(spark, src, dst, state)
    assert spark.read.parquet(dst).count() == 6
    drop("b.jsonl", everything[6:])
    incremental.run_incremental(spark, src, dst, state, files_per_batch=1)
    incremental.run_incremental(spark, src, dst, state)
    got = spark.read.parquet(dst)
    batch = diverge(normalize_pairs(tables.read_table(spark, "predictions", src)))
    columns = ["index", "prefix", "suffix", "normalized_predict", F.to_json("divergence_meta").alias("meta")]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))
    assert got.count() == 10


def test_broken_lines_leave_the_stream_and_a_replay_adds_nothing(spark, tmp_path):
    src, dst, state = (str(tmp_path / n) for n in ("src", "dst", "state"))
    (tmp_path / "src").mkdir()
    good = [json.dumps({"index": i, **r}) for i, r in enumerate(predictions(6))]
    (tmp_path / "src" / "a.jsonl").write_text("\n".join([good[0], '{"index": 77', good[1], "", "not json"]))
    incremental.run_incremental(spark, src, dst, state)
    (tmp_path / "src" / "b.jsonl").write_text("\n".join([good[2], good[3], '{"index": "text"}', good[4]]))
    incremental.run_incremental(spark, src, dst, state)

    def found():
        rows = sorted((r["index"], r.batch) for r in spark.read.parquet(dst).select("index", "batch").collect())
        return rows, sorted((r.line, r.batch) for r in spark.read.parquet(f"{dst}-rejects").collect())

    expected = ([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)], [("not json", 0), ('{"index": "text"}', 1), ('{"index": 77', 0)])
    assert found() == expected
    # The last batch was written, but the run ended before it was noted as done.
    for path in (tmp_path / "state" / "commits").glob("*1*"):
        path.unlink()
    incremental.run_incremental(spark, src, dst, state)
    assert found() == expected
    (tmp_path / "src" / "c.jsonl").write_text(good[5])
    incremental.run_incremental(spark, src, dst, state, rejects=str(tmp_path / "other"))
    assert found()[0] == [*expected[0], (5, 2)] and spark.read.parquet(str(tmp_path / "other")).count() == 0


def test_landing_counts_in_one_parse(spark, tmp_path):
    good = [json.dumps({"index": i, "predict": "é", "extra": [1]}, ensure_ascii=False) for i in range(5)]
    (tmp_path / "x.jsonl").write_text("\n".join([good[0], "{", good[1], "", "  ", "not json", *good[2:], "null"]) + "\n")
    seen = tables.land_jsonl(spark, "predictions", str(tmp_path / "x.jsonl"), str(tmp_path / "table"))
    rows, rejected = tables.read_landed(spark, "predictions", str(tmp_path / "table"))
    assert seen == {"rows": 5, "rejected": 3}
    assert sorted((r["index"], r.predict, r.label) for r in rows.collect()) == [(i, "é", None) for i in range(5)]
    assert sorted(r.line for r in rejected.collect()) == ["not json", "null", "{"]
    (tmp_path / "none.jsonl").write_text("\n")
    assert tables.land_jsonl(spark, "predictions", str(tmp_path / "none.jsonl"), str(tmp_path / "none")) == {"rows": 0, "rejected": 0}


@pytest.mark.parametrize("indent", [2, 4])
def test_one_array_file_in_many_splits(spark, tmp_path, indent):
    rows = [{"index": i, "prompt": "a\n  },\n  {\n b", "predict": "x" * (i % 50), "label": "]", "more": [{"a": [{}]}, {"b": 1}]} for i in range(800)]
    (tmp_path / "big.json").write_text(json.dumps(rows, indent=indent))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = tables.read_array_splits(spark, "predictions", str(tmp_path / "big.json"), indent)
        assert read.rdd.getNumPartitions() > 20
        got = read.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(tables.read_table(spark, "predictions", str(tmp_path / "big.json"), "json_array").collect())
    assert len(got) == 800


def test_arrays_of_another_layout_are_refused(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(predictions(3)))
    (tmp_path / "none.json").write_text("[]\n")
    (tmp_path / "four.json").write_text(json.dumps(predictions(3), indent=4))
    (tmp_path / "single.json").write_text(json.dumps(predictions(1), indent=2))
    for name in ("one", "four"):
        with pytest.raises(Exception, match="no array of objects"):
            tables.read_array_splits(spark, "predictions", str(tmp_path / f"{name}.json")).collect()
    assert tables.read_array_splits(spark, "predictions", str(tmp_path / "none.json")).count() == 0
    assert tables.read_array_splits(spark, "predictions", str(tmp_path / "single.json")).count() == 1


def test_a_rerun_replaces_its_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "n int, kind string")
    path = str(tmp_path / "sets")
    tables.write_set(rows, path, "parquet", partition_by="kind", mode="replace")
    for _ in range(2):
        tables.write_set(rows.filter("n IN (2, 3)"), path, "parquet", partition_by="kind", mode="replace")
    assert sorted((r.n, r.kind) for r in spark.read.parquet(path).collect()) == [(2, "a"), (3, "b"), (4, "c")]
    with pytest.raises(ValueError):
        tables.write_set(rows, path, "parquet", mode="replace")
