"""Resumable runs over growing folders of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.operators.diverge import diverge
from forkline.operators.normalize import normalize_pairs
from forkline.schemas import SCHEMAS


def divergences(predictions: DataFrame) -> DataFrame:
    """The stateless work of one run; the same for a batch and for a stream."""
    return diverge(normalize_pairs(predictions))


def read_stream(
    spark: SparkSession, src: str, layout: str = "jsonl", files_per_batch: int | None = None
) -> DataFrame:
    """New files of ``src`` as they come; ``files_per_batch`` bounds a micro-batch.

    JSON lines that cannot be read come as rows whose only value is ``_corrupt``, the line.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if layout == "parquet":
        return reader.schema(SCHEMAS["predictions"]).parquet(src)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.schema(SCHEMAS["predictions"] + ", _corrupt string").json(src)


def land_batch(batch: DataFrame, batch_id: int, dst: str, rejects: str) -> None:
    """Write a micro-batch: divergences of its rows to ``dst``, broken lines to ``rejects``.

    Each batch has a folder of its own by its id, and a batch that runs again replaces it, so a
    replay adds nothing.  The batch is parsed once for both.
    """
    place = f"batch={batch_id}"
    if "_corrupt" not in batch.columns:
        divergences(batch).write.mode("overwrite").parquet(f"{dst}/{place}")
        return
    kept = batch.persist()
    broken = F.col("_corrupt").isNotNull()
    divergences(kept.filter(~broken).drop("_corrupt")).write.mode("overwrite").parquet(f"{dst}/{place}")
    kept.filter(broken).select(F.col("_corrupt").alias("line")).write.mode("overwrite").parquet(f"{rejects}/{place}")
    kept.unpersist()


def append_divergences(predictions: DataFrame, dst: str, checkpoint: str) -> None:
    """Process what is new, append it to ``dst`` as parquet and stop.

    The checkpoint records which input is done: an interrupted run goes on where it
    stopped, a finished one adds nothing, and earlier output is never rewritten.
    """
    query = (
        divergences(predictions)
        .writeStream.format("parquet")
        .option("path", dst)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_incremental(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    layout: str = "jsonl",
    files_per_batch: int | None = None,
    rejects: str | None = None,
) -> None:
    """Process what is new in ``src`` and stop.

    Rows go to ``dst`` and lines that are not valid JSON to ``rejects`` (``dst`` with the ending
    ``-rejects`` unless given), both with the column ``batch``.  A batch that was interrupted runs
    again as a whole and replaces what it had written.
    """
    lines = rejects or f"{dst.rstrip('/')}-rejects"
    query = (
        read_stream(spark, src, layout, files_per_batch)
        .writeStream.foreachBatch(lambda batch, n: land_batch(batch, n, dst, lines))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
