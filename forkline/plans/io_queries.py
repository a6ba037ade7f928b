"""Queries through files and streams.  They write below the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.plans import fixtures as fx
from forkline.plans import oracle_parts as o
from forkline.plans.eval_queries import _CLASS_LIST, _CLASSED, _classified
from forkline.plans.registry import query
from forkline.session import scratch_root
from forkline.sources import tables
from forkline.streaming import incremental


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("jsonl_roundtrip", o.with_pairs("SELECT index, prompt, predict, label FROM sql_pairs"))
def jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "predictions")
    tables.write_set(fx.sql_pairs(spark, sf).select("index", "prompt", "predict", "label"), path)
    return tables.read_table(spark, "predictions", path)


@query(
    "jsonl_tolerant",
    o.with_pairs(
        """SELECT index, predict, CAST(NULL AS VARCHAR) AS line FROM sql_pairs WHERE index % 7 <> 3
           UNION ALL SELECT NULL, NULL, '{"index": ' || CAST(index AS STRING) || ', "predict": ' FROM sql_pairs WHERE index % 7 = 3"""
    ),
)
def tolerant(spark: SparkSession, sf: str) -> DataFrame:
    """Lines cut short are set aside, the others are read."""
    pairs = fx.sql_pairs(spark, sf)
    whole = F.to_json(F.struct("index", "predict", "label"))
    cut = F.concat(F.lit('{"index": '), F.col("index").cast("string"), F.lit(', "predict": '))
    path = _folder(spark, "lines")
    pairs.select(F.when(F.col("index") % 7 == 3, cut).otherwise(whole).alias("value")).write.text(path)
    rows, rejected = tables.read_jsonl_tolerant(spark, "predictions", path)
    return rows.select("index", "predict", F.lit(None).cast("string").alias("line")).unionByName(
        rejected.select(
            F.lit(None).cast("bigint").alias("index"), F.lit(None).cast("string").alias("predict"), "line"
        )
    )


@query(
    "json_array_scan",
    o.with_pairs("SELECT index, prompt, predict, label FROM sql_pairs"),
)
def array_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one JSON array each, of some thousand samples, as the first stages get them."""
    rows = fx.sql_pairs(spark, sf).select(
        F.struct("index", "prompt", "predict", "label").alias("row"),
        F.call_function("div", F.col("index"), F.lit(8000)).alias("part"),
    )
    path = _folder(spark, "arrays")
    arrays = rows.groupBy("part").agg(F.to_json(F.collect_list("row")).alias("value"))
    arrays.write.partitionBy("part").text(path)
    read = tables.read_table(spark, "predictions", path, "json_array")
    return read.select("index", "prompt", "predict", "label")


@query(
    "incremental_resume",
    o.with_d("SELECT index, np AS normalized_predict, 'run ' || CAST(2 - index % 2 AS STRING) AS run FROM d"),
)
def resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Two drops of JSON lines; the second run takes only what the first has not done."""
    pairs = fx.sql_pairs(spark, sf).select("index", "prompt", "predict", "label")
    root = _folder(spark, "resume")
    done = None
    for n, odd in ((1, 1), (2, 0)):
        tables.write_set(pairs.filter(F.col("index") % 2 == odd), f"{root}/drop", mode="append")
        incremental.run_incremental(spark, f"{root}/drop", f"{root}/table", f"{root}/checkpoint")
        rows = spark.read.parquet(f"{root}/table").select("index", "normalized_predict")
        new = rows if done is None else rows.exceptAll(done.select("index", "normalized_predict"))
        new = tables.stored(new.withColumn("run", F.lit(f"run {n}")), "resume-rows")
        done = new if done is None else done.unionByName(new)
    return done


_CUT_LINE = """'{"index": ' || CAST(index AS STRING) || ', "predict": '"""


def _lines_with_breaks(pairs: DataFrame) -> DataFrame:
    """Pairs as JSON lines, of which every seventh is cut short."""
    whole = F.to_json(F.struct("index", "prompt", "predict", "label"))
    cut = F.concat(F.lit('{"index": '), F.col("index").cast("string"), F.lit(', "predict": '))
    return pairs.select(F.when(F.col("index") % 7 == 3, cut).otherwise(whole).alias("value"))


@query(
    "incremental_rejects",
    o.with_d(
        f"""SELECT index, np AS normalized_predict, CAST(NULL AS VARCHAR) AS line, CAST(1 - index % 2 AS INT) AS batch FROM d WHERE index % 7 <> 3
            UNION ALL SELECT NULL, NULL, {_CUT_LINE}, CAST(1 - index % 2 AS INT) FROM d WHERE index % 7 = 3"""
    ),
)
def streamed_with_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Two drops with broken lines, three runs; the last one finds nothing new."""
    pairs = fx.sql_pairs(spark, sf)
    root = _folder(spark, "rejects")
    for odd in (1, 0):
        _lines_with_breaks(pairs.filter(F.col("index") % 2 == odd)).write.mode("append").text(f"{root}/drop")
        incremental.run_incremental(spark, f"{root}/drop", f"{root}/table", f"{root}/checkpoint")
    incremental.run_incremental(spark, f"{root}/drop", f"{root}/table", f"{root}/checkpoint")
    rows = spark.read.parquet(f"{root}/table").select("index", "normalized_predict", F.lit(None).cast("string").alias("line"), "batch")
    lines = spark.read.parquet(f"{root}/table-rejects")
    return rows.unionByName(lines, allowMissingColumns=True)


@query(
    "land_rejects",
    o.with_pairs(
        """SELECT CASE WHEN index % 7 = 3 THEN 'rejected' ELSE 'rows' END AS kind, count(*) AS observed, count(*) AS n_rows,
             CAST(sum(CASE WHEN index % 7 = 3 THEN 0 ELSE index END) AS BIGINT) AS index_sum FROM sql_pairs GROUP BY ALL"""
    ),
)
def landed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and broken lines landed in one parse; what was counted on the way and what is there."""
    root = _folder(spark, "landing")
    _lines_with_breaks(fx.sql_pairs(spark, sf)).write.text(f"{root}/lines")
    seen = tables.land_jsonl(spark, "predictions", f"{root}/lines", f"{root}/table")
    rows, rejected = tables.read_landed(spark, "predictions", f"{root}/table")
    counted = [
        part.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(number), F.lit(0)).alias("index_sum")).select(
            F.lit(kind).alias("kind"), F.lit(seen[kind]).cast("bigint").alias("observed"), "n_rows", "index_sum"
        )
        for kind, part, number in (("rows", rows, F.col("index")), ("rejected", rejected, F.lit(0).cast("bigint")))
    ]
    return counted[0].unionByName(counted[1])


@query(
    "json_array_splits",
    o.with_pairs("SELECT index, prompt, predict, label FROM sql_pairs"),
)
def array_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Indented array files of some thousand samples, read by records and landed as parquet."""
    text = F.to_json(F.struct("index", "prompt", "predict", "label"), {"pretty": "true"})
    record = F.regexp_replace(text, "(?m)^", "  ")
    rows = fx.sql_pairs(spark, sf).select(record.alias("record"), F.call_function("div", F.col("index"), F.lit(8000)).alias("part"))
    root = _folder(spark, "indented")
    body = F.array_join(F.collect_list("record"), ",\n")
    rows.groupBy("part").agg(F.concat(F.lit("[\n"), body, F.lit("\n]")).alias("value")).write.partitionBy("part").text(f"{root}/arrays")
    read = tables.read_array_splits(spark, "predictions", f"{root}/arrays")
    read.write.parquet(f"{root}/table")
    return tables.read_table(spark, "predictions", f"{root}/table", "parquet")


@query(
    "class_files_rerun",
    f"""WITH {_CLASSED}, e AS (SELECT index, unnest([CASE WHEN c1 THEN 1 END, CASE WHEN c2 THEN 2 END, CASE WHEN c3 THEN 3 END]) AS c FROM classed)
        SELECT index, CAST(c AS INT) AS error_class FROM e WHERE c = 3 OR c IN (1, 2) AND index % 2 = 0""",
)
def class_files_rerun(spark: SparkSession, sf: str) -> DataFrame:
    """A rerun of two classes replaces their folders and leaves the third as it is."""
    path = _folder(spark, "classes")
    rows = tables.stored(_classified(spark, sf).select("index", F.explode("classes").alias("error_class")), "class-rows")
    tables.write_set(rows, path, "parquet", partition_by="error_class")
    again = rows.filter((F.col("error_class") < 3) & (F.col("index") % 2 == 0))
    tables.write_set(again, path, "parquet", partition_by="error_class", mode="replace")
    return spark.read.parquet(path).select("index", "error_class")


@query(
    "class_files",
    f"""WITH {_CLASSED}, e AS (SELECT index, unnest([CASE WHEN c1 THEN 1 END, CASE WHEN c2 THEN 2 END, CASE WHEN c3 THEN 3 END]) AS c, {_CLASS_LIST} AS l FROM classed)
        SELECT index, CAST(c AS INT) AS error_class FROM e WHERE c IS NOT NULL""",
)
def class_files(spark: SparkSession, sf: str) -> DataFrame:
    """One folder per class, read back with the class as partition column."""
    path = _folder(spark, "classes")
    rows = _classified(spark, sf).select("index", "suffix", F.explode("classes").alias("error_class"))
    tables.write_set(rows, path, "parquet", partition_by="error_class")
    return spark.read.parquet(path).select("index", "error_class")


@query(
    "row_positions",
    "SELECT row_number() OVER () - 1 AS index, l_orderkey, l_linenumber, l_partkey FROM lineitem",
)
def positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.with_position(fx.table(spark, sf, "lineitem"))
    return rows.select("index", "l_orderkey", "l_linenumber", "l_partkey")


@query(
    "incremental_divergences",
    o.with_d("SELECT index, np AS normalized_predict, prefix, suffix, CASE WHEN diverged THEN reason END AS reason FROM d"),
)
def streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The orders file as a stream of pairs, appended to a table under a checkpoint."""
    # A stream takes folders or patterns, and the table may be one file or a folder of files.
    orders = spark.readStream.schema(fx.table(spark, sf, "orders").schema).parquet(
        f"{sf}/orders.parque[t]"
    )
    pairs = spark.sql(fx.SQL_PAIRS, orders=orders)
    root = _folder(spark, "incremental")
    incremental.append_divergences(
        pairs.select("index", "prompt", "predict", "label"), f"{root}/table", f"{root}/checkpoint"
    )
    return spark.read.parquet(f"{root}/table").select(
        "index", "normalized_predict", "prefix", "suffix", F.col("divergence_meta.reason").alias("reason")
    )


@query(
    "summary_file",
    """SELECT count(*) AS total, CAST(count_if(o_orderkey % 3 = 0) AS BIGINT) AS exec_correct FROM orders""",
)
def summary(spark: SparkSession, sf: str) -> DataFrame:
    """The report row, written and read back."""
    from forkline.operators.evaluate import accuracy

    rows = fx.table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 3 == 0).alias("exec_match"),
        F.lit(False).alias("no_db_id"),
        F.lit(False).alias("parse_error"),
        F.lit(False).alias("exec_error"),
    )
    path = _folder(spark, "summary")
    tables.write_summary(accuracy(rows), path)
    return spark.read.schema("total bigint, exec_correct bigint").json(path)
