"""Files to tables and back, always under a declared schema."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from forkline.schemas import SCHEMAS
from forkline.session import scratch_root

# Splits whose offsets are sent to all tasks; a map of so many small rows is some 100 MB.
BROADCAST_SPLITS = 1_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, size known."""
    path = f"{scratch_root(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, kind: str, path: str, layout: str = "jsonl") -> DataFrame:
    """A table of :data:`forkline.schemas.SCHEMAS` from files.

    ``jsonl`` is splittable and skips blank lines.  ``json_array`` reads each file, one
    array of objects, in a single task: land such a file once as parquet.
    """
    if layout not in ("jsonl", "json_array", "parquet"):
        raise ValueError(f"unknown layout {layout!r}")
    reader = spark.read.schema(SCHEMAS[kind])
    if layout == "parquet":
        return reader.parquet(path)
    return reader.option("multiLine", layout == "json_array").json(path)


def read_positioned(spark: SparkSession, kind: str, path: str, layout: str = "jsonl") -> DataFrame:
    """Like :func:`read_table`; rows without an ``index`` get their position in the files."""
    table = with_position(read_table(spark, kind, path, layout), "_position")
    if "index" in table.columns:
        return table.withColumn("index", F.coalesce("index", "_position")).drop("_position")
    return table.withColumnRenamed("_position", "index")


def with_position(scan: DataFrame, name: str = "index") -> DataFrame:
    """Add the 0-based row position over the files in name order.

    ``scan`` must be a file scan.  Rows of one file split are numbered where they are
    read; only the row count of each split moves.  Sums run inside a file, and then over
    files, one small row each; the counts are stored, and as long as there are no more than
    ``BROADCAST_SPLITS`` they go to the rows, so that the data itself is not moved.
    """
    tagged = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    splits = stored(
        tagged.groupBy("_file", "_block").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n")),
        "splits",
    )
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        splits.groupBy("_file")
        .agg(F.sum("_n").alias("_rows"))
        .select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    shifts = (
        splits.withColumn("_inside", inside)
        .join(files, "_file")
        .select("_file", "_block", (F.col("_base") + F.col("_inside") - F.col("_first")).alias("_shift"))
    )
    if splits.count() <= BROADCAST_SPLITS:
        shifts = F.broadcast(shifts)
    return (
        tagged.join(shifts, ["_file", "_block"])
        .withColumn(name, F.col("_seq") + F.col("_shift"))
        .drop("_file", "_block", "_seq", "_shift")
    )


def parsed_lines(lines: DataFrame, kind: str, value: Column | None = None) -> tuple[DataFrame, Column]:
    """Text lines with the row each one holds, and the test for lines that hold none."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    text = F.col("value") if value is None else value
    row = F.from_json(text, SCHEMAS[kind] + ", _corrupt string", options)
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    return lines.select("value", row.alias("row")), bad


def read_jsonl_tolerant(spark: SparkSession, kind: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of a JSONL file in which some lines are not valid JSON.

    Both are filters over one parse of the file: a caller that uses both parses it twice, or
    lands the file first (:func:`land_jsonl`).
    """
    parsed, bad = parsed_lines(spark.read.text(path), kind)
    rows = parsed.filter(~bad).select("row.*").drop("_corrupt")
    return rows, parsed.filter(bad).select(F.col("value").alias("line"))


def land_jsonl(spark: SparkSession, kind: str, path: str, dst: str, mode: str = "errorifexists") -> dict[str, int]:
    """Land a JSONL file with broken lines as parquet, in one parse; how many rows and rejected lines.

    Rows and rejected lines go to one table whose partitions keep them apart; the counts are
    observed while it is written.  Blank lines are neither.  :func:`read_landed` gives both.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed, bad = parsed_lines(lines, kind)
    seen = Observation("lines")
    counts = [F.count_if(~F.col("rejected")).alias("rows"), F.count_if("rejected").alias("rejected")]
    marked = parsed.withColumn("rejected", bad).observe(seen, *counts)
    line = F.when(F.col("rejected"), F.col("value")).alias("line")
    names = [f.name for f in marked.schema["row"].dataType.fields if f.name != "_corrupt"]
    whole = marked.select(*[F.when(~F.col("rejected"), F.col(f"row.{n}")).alias(n) for n in names], line, "rejected")
    whole.write.mode(mode).partitionBy("rejected").parquet(dst)
    return seen.get


def read_landed(spark: SparkSession, kind: str, dst: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) that :func:`land_jsonl` has written; each reads its own partition."""
    table = spark.read.schema(SCHEMAS[kind] + ", line string, rejected boolean").parquet(dst)
    return table.filter(~F.col("rejected")).drop("line", "rejected"), table.filter("rejected").select("line")


def read_array_splits(spark: SparkSession, kind: str, path: str, indent: int = 2) -> DataFrame:
    """Rows of files that hold one indented JSON array of objects each, however large, in splits.

    An indented array ends one record and begins the next with three lines of their own, which
    no string can hold, as line breaks in strings are escaped; that is the record separator.
    A file laid out otherwise fails with a message instead of losing rows; read it with layout
    ``json_array``.
    """
    pad = " " * indent
    separator = f"\n{pad}}},\n{pad}{{\n"
    text = spark.read.option("lineSep", separator).text(path)
    # The brackets of the array stand at the start and end of a file, less indented than any record.
    inner = F.regexp_replace("value", rf"\A\s*\[\n{pad}\{{\n|\n{pad}\}}\n\]\s*\z", "")
    records = text.filter(~F.rlike("value", F.lit(r"\A\s*(\[\s*\])?\s*\z")))
    parsed, bad = parsed_lines(records, kind, F.concat(F.lit("{"), inner, F.lit("}")))
    fits = F.when(~bad, F.lit(True)).otherwise(F.raise_error(F.lit(f"{path} is no array of objects with indent {indent}")).cast("boolean"))
    return parsed.filter(fits).select("row.*").drop("_corrupt")


def bucketed(df: DataFrame, name: str, key: str = "index", buckets: int | None = None) -> DataFrame:
    """``df`` laid out once by ``key`` in the shared folder, as a table of this session.

    Tables with equal ``buckets`` are joined and grouped by ``key`` where they lie, without a
    shuffle.  Each bucket is one file; there are as many as shuffle partitions unless given.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark).rstrip('/')}/{unique}"
    laid = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
    laid.format("parquet").saveAsTable(unique)
    return spark.table(unique)


def write_set(
    df: DataFrame,
    path: str,
    layout: str = "jsonl",
    partition_by: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write a table as JSON lines, null keys kept, or as parquet.

    With ``mode="replace"`` a rerun replaces the partitions that it writes and leaves the others
    as they are.
    """
    if mode == "replace":
        if not partition_by:
            raise ValueError("only partitions can be replaced")
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if layout == "jsonl":
        writer.option("ignoreNullFields", False).json(path)
    elif layout == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown layout {layout!r}")


def write_summary(counters: DataFrame, path: str) -> None:
    """The one row of :func:`forkline.operators.evaluate.accuracy` as JSON."""
    write_set(counters.coalesce(1), path, "jsonl")
