"""Label masks, forget masks, batches and padding on supplied token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.functions.text import let, strip, text_or_empty
from forkline.schemas import UNSCORED
from forkline.sources.tables import stored

# What each array is padded with; the id to pad with belongs to the vocabulary.
PADDING = {"input_ids": 0, "attention_mask": 0, "labels": UNSCORED, "forget_mask": 0}


def truncate(ids: Column, max_length: int | None = None) -> Column:
    """The first ``max_length`` ids where a caller asks for a cut, else all."""
    return ids if max_length is None else F.slice(ids, 1, max_length)


def header_end(ids: Column, header: Column) -> Column:
    """Position after the first header, null when there is none."""
    size = F.size(header)
    # Only positions that hold the first header id are compared in full.
    starts = F.filter(
        F.transform(ids, lambda x, i: F.when(x == F.get(header, F.lit(0)), i)),
        lambda i: i.isNotNull() & (F.slice(ids, i + 1, size) == header),
    )
    return F.get(starts, F.lit(0)) + size


def label_mask(ids: Column, end: Column) -> Column:
    """Labels unscored up to the header's end; without a header nothing is masked."""
    masked = F.transform(ids, lambda x, i: F.when(i < end, F.lit(UNSCORED)).otherwise(x))
    return F.when(end.isNull(), ids).otherwise(masked)


def _ones(ids: Column, start: Column, stop: Column) -> Column:
    return F.transform(ids, lambda _, i: ((i >= start) & (i < stop)).cast("int"))


def _tokens_before(pieces: Column, length: Column) -> Column:
    """How many pieces start before the character ``length``: one fold over lengths."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("n"))
    return F.aggregate(
        pieces,
        start,
        lambda s, p: F.struct(
            (s["pos"] + F.length(p)).alias("pos"),
            (s["n"] + (s["pos"] < length).cast("int")).alias("n"),
        ),
        lambda s: s["n"],
    )


def forget_mask(
    ids: Column,
    token_texts: Column,
    start: Column,
    answer: Column,
    answer_tokens: Column,
    tail: Column,
    part: Column,
    mode: Column,
    lookahead: int | None = None,
) -> Column:
    """0/1 per token.

    The first visible token is looked for among the ``lookahead`` tokens after ``start``,
    among all of them by default.

    No tail: the whole answer.  Tail not at the end of the answer: all from the first
    visible token.  Else First marks the token where the tail's first occurrence begins,
    Whole the tokens of ``part`` from there; an unknown mode is First.
    """
    # What a lambda captures is evaluated for every element, so positions are bound first.
    size = F.size(ids)
    ahead = F.slice(token_texts, start + 1, size if lookahead is None else F.lit(lookahead))
    visible = F.array_position(F.transform(ahead, lambda t: strip(t) != ""), True)
    content = start + F.greatest(visible - 1, F.lit(0)).cast("int")
    found = F.instr(answer, tail)
    usable = (found > 0) & F.endswith(answer, tail)
    lead = let(found - 1, lambda at: _tokens_before(answer_tokens, at))
    part_end = let(
        found - 1 + F.length(F.coalesce(part, tail)), lambda at: _tokens_before(answer_tokens, at)
    )
    begin = F.when(tail.isNull(), start).when(usable, content + lead).otherwise(content)
    end = (
        F.when(tail.isNull() | ~usable, size)
        .when(mode == "Whole", content + part_end)
        .otherwise(content + lead + 1)
    )
    return let(F.struct(begin.alias("at"), end.alias("to")), lambda r: _ones(ids, r["at"], r["to"]))


def encoded(sample: Column, header_ids: list[int], max_length: int | None, with_tail: bool) -> Column:
    """Struct of input_ids, attention_mask, labels and forget_mask of one sample struct."""
    header = F.array(*[F.lit(i) for i in header_ids])
    nothing = F.lit(None).cast("string")

    def build(ids: Column) -> Column:
        return let(header_end(ids, header), lambda end: with_end(ids, end))

    def with_end(ids: Column, end: Column) -> Column:
        return F.struct(
            ids.alias("input_ids"),
            F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"),
            label_mask(ids, end).alias("labels"),
            forget_mask(
                ids,
                sample["token_texts"],
                F.coalesce(end, F.size(ids)),
                text_or_empty(sample["answer"]),
                sample["answer_tokens"],
                sample["forget_tail"] if with_tail else nothing,
                sample["forget_part"] if with_tail else nothing,
                F.coalesce(sample["forget_mode"], F.lit("First")) if with_tail else F.lit("First"),
            ).alias("forget_mask"),
        )

    return let(truncate(sample["input_ids"], max_length), build)


def encode_samples(
    samples: DataFrame, header_ids: list[int], max_length: int | None = None
) -> DataFrame:
    """Add attention_mask, labels and forget_mask to token arrays, cut only on request.

    Takes ``input_ids`` with the text of each in ``token_texts``, ``answer`` with its own
    ``answer_tokens``, and ``forget_tail``, ``forget_part``, ``forget_mode``.  The ids do not
    come from the encoded struct, so that a use of lengths alone builds no masks.
    """
    sample = F.struct(*[F.col(c) for c in samples.columns])
    rows = samples.withColumn("_e", encoded(sample, header_ids, max_length, with_tail=True))
    ids = truncate(F.col("input_ids"), max_length)
    return rows.withColumns({c: F.col(f"_e.{c}") for c in PADDING} | {"input_ids": ids}).drop("_e")


def build_masks(
    pairs: DataFrame, header_ids: list[int], max_length: int | None = None
) -> DataFrame:
    """Encode both sides of ``index, forget, retain``; a retain sample is scored whole.

    As in :func:`encode_samples`, lengths alone need no masks.
    """
    sides = ("forget", "retain")
    rows = pairs.withColumns(
        {f"_{s}": encoded(F.col(s), header_ids, max_length, with_tail=s == "forget") for s in sides}
    )

    def fields(side: str) -> Column:
        ids = truncate(F.col(f"{side}.input_ids"), max_length)
        rest = [F.col(f"_{side}.{c}") for c in PADDING if c != "input_ids"]
        return F.struct(ids.alias("input_ids"), *rest)

    return rows.withColumns({s: fields(s) for s in sides}).drop("_forget", "_retain")


def _padded(fields: Column, longest: Column, pad_id: int) -> Column:
    missing = F.greatest(longest - F.size(fields["input_ids"]), F.lit(0))
    fill = PADDING | {"input_ids": pad_id}
    return F.struct(
        *[
            F.concat(fields[name], F.array_repeat(F.lit(value), missing)).alias(name)
            for name, value in fill.items()
        ]
    )


#: Batches whose lengths are sent to all tasks; a map of so many small rows is some 100 MB.
BROADCAST_BATCHES = 1_000_000


def with_longest(rows: DataFrame, lengths: dict[str, Column]) -> DataFrame:
    """Add the greatest of each length in its ``batch_id``.

    Only batch and lengths are shuffled.  The maxima, one small row per batch, are stored and
    go to the rows, so that the arrays are not moved; beyond ``BROADCAST_BATCHES`` batches the
    join is left to Spark.
    """
    narrow = rows.select("batch_id", *[length.alias(name) for name, length in lengths.items()])
    maxima = narrow.groupBy(F.col("batch_id").alias("_batch")).agg(*[F.max(name).alias(name) for name in lengths])
    maxima = stored(maxima, "batches")
    if maxima.count() <= BROADCAST_BATCHES:
        maxima = F.broadcast(maxima)
    return rows.join(maxima, F.col("batch_id").eqNullSafe(F.col("_batch"))).drop("_batch")


def _length(ids: Column, max_length: int | None) -> Column:
    return F.size(ids) if max_length is None else F.least(F.size(ids), F.lit(max_length))


def _cut(fields: Column, max_length: int | None) -> Column:
    """All arrays of a sample cut alike, so that no row is longer than its batch."""
    return F.struct(*[truncate(fields[name], max_length).alias(name) for name in PADDING])


def batch_pad(
    encoded_rows: DataFrame, batch_size: int, pad_id: int, max_length: int | None = None
) -> DataFrame:
    """Batches of consecutive ``index`` values, padded to the longest row of each.

    The arrays are not shuffled, only their lengths are (see :func:`with_longest`).
    """
    fields = F.struct(*[F.col(c) for c in PADDING])
    rows = encoded_rows.withColumn("batch_id", batch_of(F.col("index"), batch_size))
    return (
        with_longest(rows, {"_longest": _length(F.col("input_ids"), max_length)})
        .withColumn("_f", _cut(fields, max_length))
        .withColumn("_p", _padded(F.col("_f"), F.col("_longest"), pad_id))
        .withColumns({c: F.col(f"_p.{c}") for c in PADDING})
        .drop("_f", "_p", "_longest")
    )


def batch_pad_pairs(
    masked: DataFrame, batch_size: int, pad_id: int, max_length: int | None = None
) -> DataFrame:
    """Pad each side of encoded pairs to its own longest row; retain needs no forget mask.

    Both maxima come from the one shuffle of lengths by batch.
    """
    rows = masked.withColumn("batch_id", batch_of(F.col("index"), batch_size))
    sides = ("forget", "retain")
    rows = with_longest(rows, {f"_{s}": _length(F.col(f"{s}.input_ids"), max_length) for s in sides})
    rows = rows.withColumns({s: _cut(F.col(s), max_length) for s in sides})
    padded = {s: _padded(F.col(s), F.col(f"_{s}"), pad_id) for s in sides}
    padded["retain"] = padded["retain"].dropFields("forget_mask")
    return rows.withColumns(padded).drop("_forget", "_retain")


def batch_of(index: Column, batch_size: int) -> Column:
    """Fixed-size batches in row order."""
    return F.call_function("div", index, F.lit(batch_size)).cast("bigint")


def mask_coverage(masked: DataFrame) -> DataFrame:
    """Scored tokens, forget tokens and their ratios per row.

    Position 0 is never predicted, so ``scored``, ``forget`` and ``ratio`` leave it out;
    ``sequence_ratio`` is over the whole sequence.
    """
    scored = F.size(F.filter("labels", lambda x, i: (i > 0) & (x != UNSCORED)))
    marked = F.aggregate(F.slice("forget_mask", F.lit(2), F.size("forget_mask")), F.lit(0), lambda n, x: n + x)
    all_marked = F.aggregate("forget_mask", F.lit(0), lambda n, x: n + x)
    return masked.select(
        "index",
        scored.alias("scored"),
        marked.alias("forget"),
        (marked / F.greatest(scored, F.lit(1))).alias("ratio"),
        F.try_divide(all_marked, F.size("forget_mask")).alias("sequence_ratio"),
    )
