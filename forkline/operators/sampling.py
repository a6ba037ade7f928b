"""Seeded order, dense ranks, splits, samples and pairs.

The order is that of ``md5(seed:key)``: the same on any cluster and any partitioning.
Ranks come from buckets by the leading hex digits of that hash.  How many digits follows
from the number of rows, so that a bucket holds at most about ``BUCKET_ROWS`` of them; the
bucket counts give each bucket its offset, and inside a bucket ``row_number`` ranks its
even share of the rows.  Offsets are sums on two levels: buckets that share the first half
of their digits are summed up inside of their range, and only the ranges, as many as the root of
the number of buckets, meet in one task.  Buckets beyond a wanted rank are dropped before the shuffle where
Spark can broadcast the counts, so taking n rows moves about n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forkline.functions.prompts import question_lenient
from forkline.functions.text import text_or_empty

BUCKET_ROWS = 100_000


def order_key(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _keyed(df: DataFrame, key: str, seed: int | str, bucket_rows: int) -> DataFrame:
    size = df.agg(F.count("*")).scalar()
    digits = F.ceil(F.log(16.0, F.greatest(size / F.lit(bucket_rows), F.lit(1.0)))).cast("int")
    keyed = df.withColumn("_k", order_key(seed, F.col(key)))
    return keyed.withColumn("_b", F.substr("_k", F.lit(1), digits))


def bucket_offsets(counts: DataFrame, names: dict[str, str]) -> DataFrame:
    """``_b`` with the sums over all earlier buckets, named as ``names`` maps the counts, and
    with the sums over all buckets (``_all`` and the count's name).

    A range is the first half of a bucket's digits.  Sums inside a range are windows of their
    own; the one window without partitions sees a row per range.
    """
    ranged = counts.withColumn("_t", F.substr("_b", F.lit(1), F.ceil(F.length("_b") / 2).cast("int")))
    earlier_ranges = Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    earlier_buckets = Window.partitionBy("_t").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        ranged.groupBy("_t")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            "_t",
            *[F.coalesce(F.sum(n).over(earlier_ranges), F.lit(0)).alias(f"_base_{n}") for n in names],
            *[F.sum(n).over(Window.partitionBy()).alias(f"_all{n}") for n in names],
        )
    )
    inside = [F.coalesce(F.sum(n).over(earlier_buckets), F.lit(0)).alias(f"_in_{n}") for n in names]
    sums = [(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(name) for n, name in names.items()]
    return ranged.select("_b", "_t", *inside).join(ranges, "_t").select("_b", *sums, *[f"_all{n}" for n in names])


def seeded_rank(
    df: DataFrame,
    key: str,
    seed: int | str,
    upto: int | None = None,
    exact: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``rank``, dense from 0 in seeded order; with ``upto`` only ranks below it.

    ``exact`` counts first and fails when there are fewer than ``upto`` rows.
    """
    if exact and upto is not None and df.count() < upto:
        raise ValueError(f"sample of {upto} rows from fewer rows")
    keyed = _keyed(df, key, seed, bucket_rows)
    offsets = bucket_offsets(keyed.groupBy("_b").agg(F.count("*").alias("_n")), {"_n": "_off"})
    if upto is not None:
        offsets = offsets.filter(F.col("_off") < upto)
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_k", key))
    ranked = keyed.join(offsets, "_b").withColumn("rank", F.col("_off") + inside - 1)
    if upto is not None:
        ranked = ranked.filter(F.col("rank") < upto)
    return ranked.drop("_k", "_b", "_off", "_all_n")


def take_seeded(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of the seeded order, or all when there are fewer."""
    return seeded_rank(df, key, seed, upto=n).drop("rank")


def sample_items(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly ``n`` ids; every row of a chosen id is kept, so both modes agree."""
    ids = df.select(key).distinct()
    chosen = seeded_rank(ids, key, seed, upto=n, exact=True).select(key)
    return df.join(chosen, key, "left_semi")


def split_sets(
    exec_results: DataFrame,
    forget_size: int = 10_000,
    retain_size: int = 10_000,
    seed: int = 42,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Forget and retain items in one pass.

    Forget: the first failed rows, answered by the prediction.  Retain: the first
    passing rows, answered by the prediction; when they fall short, the failed rows that
    come next, answered by gold.  Rows of unknown outcome are in neither.
    """
    known = exec_results.filter(F.col("exec_match").isNotNull())
    keyed = _keyed(known, "index", seed, bucket_rows)
    failed = ~F.col("exec_match")
    counts = keyed.groupBy("_b").agg(F.count_if(failed).alias("_nf"), F.count_if("exec_match").alias("_np"))
    offsets = bucket_offsets(counts, {"_nf": "_off_f", "_np": "_off_p"})
    top_up = F.lit(retain_size) - F.least(F.col("_all_np"), F.lit(retain_size))
    wanted = F.when(failed, F.lit(forget_size) + top_up).otherwise(F.lit(retain_size))
    offset = F.when(failed, F.col("_off_f")).otherwise(F.col("_off_p"))
    inside = F.row_number().over(Window.partitionBy("exec_match", "_b").orderBy("_k", "index"))
    chosen = (
        keyed.join(offsets, "_b")
        .withColumns({"_wanted": wanted, "_off": offset})
        .filter(F.col("_off") < F.col("_wanted"))
        .withColumn("rank", F.col("_off") + inside - 1)
        .filter(F.col("rank") < F.col("_wanted"))
    )
    forget = failed & (F.col("rank") < forget_size)
    source = F.when(failed & ~forget, F.lit("label")).otherwise(F.lit("predict"))
    return chosen.select(
        F.when(forget, F.lit("forget")).otherwise(F.lit("retain")).alias("set"),
        F.col("index").cast("string").alias("id"),
        question_lenient(text_or_empty(F.col("prompt"))).alias("question"),
        F.when(source == "predict", text_or_empty(F.col("predict")))
        .otherwise(text_or_empty(F.col("label")))
        .alias("answer"),
        source.alias("answer_source"),
        F.col("exec_match").alias("original_exec_match"),
        F.col("error").alias("original_error"),
    )


def remaining_failed(exec_results: DataFrame, forget: DataFrame) -> DataFrame:
    """Failed rows that the forget set did not take."""
    taken = forget.select(F.col("id").cast("bigint").alias("index"))
    return exec_results.filter(~F.col("exec_match")).join(taken, "index", "left_anti")


def split_stats(
    exec_results: DataFrame,
    items: DataFrame,
    forget_size: int = 10_000,
    retain_size: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """One row of counts: a single aggregate over both tables' narrow columns."""
    blank = F.lit(None).cast("string")
    rows = exec_results.select(F.lit("all").alias("set"), blank.alias("answer_source")).unionByName(
        items.select("set", "answer_source")
    )
    counts = {
        f"{name}_{source}": F.count_if((F.col("set") == name) & (F.col("answer_source") == source))
        for name in ("forget", "retain")
        for source in ("predict", "label")
    }
    return rows.agg(
        F.count_if(F.col("set") == "all").alias("total_samples"),
        F.count_if(F.col("set") == "forget").alias("forget_samples"),
        F.count_if(F.col("set") == "retain").alias("retain_samples"),
        *[count.alias(name) for name, count in counts.items()],
    ).withColumns(
        {
            "forget_size_requested": F.lit(forget_size).cast("bigint"),
            "retain_size_requested": F.lit(retain_size).cast("bigint"),
            "seed": F.lit(seed).cast("bigint"),
        }
    )


def source_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("set", "answer_source").agg(F.count("*").alias("n_rows"))


def pair_sets(
    forget: DataFrame,
    retain: DataFrame,
    anchor: str = "forget",
    seed: int = 42,
    epoch: int = 0,
    key: str = "id",
) -> DataFrame:
    """Each anchor row with one row of the other set, drawn with replacement.

    The draw is a hash of (seed, epoch, key) modulo the size of the other set, so a new
    epoch gives new pairs.  Then one equi join on the dense rank of the other set: a
    small other set is broadcast by measured size, a large one is hit evenly.
    """
    if anchor not in ("forget", "retain"):
        raise ValueError(f"anchor must be forget or retain, not {anchor!r}")
    lead, other = (forget, retain) if anchor == "forget" else (retain, forget)
    other_name = "retain" if anchor == "forget" else "forget"

    def packed(df: DataFrame) -> Column:
        return F.struct(*[F.col(c) for c in df.columns])

    size = other.count()
    if not size and not lead.isEmpty():
        raise ValueError(f"no {other_name} row to pair with")
    # 60 bits of the hash reach every row of any table.
    digits = F.substring(order_key(f"{seed}:{epoch}", F.col(key)), 1, 15)
    draw = F.conv(digits, 16, 10).cast("bigint") % F.lit(max(size, 1))
    left = lead.select(packed(lead).alias(anchor), draw.alias("rank"))
    right = seeded_rank(other, key, seed).select("rank", packed(other).alias(other_name))
    return left.join(right, "rank").select("forget", "retain")
