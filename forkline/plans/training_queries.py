"""Queries on training sets: splits, samples, pairs, masks, batches, losses, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.functions.text import words
from forkline.operators import items as it
from forkline.operators import losses, masks, sampling, scores
from forkline.plans import fixtures as fx
from forkline.plans import oracle_parts as o
from forkline.plans.eval_queries import _CHARACTER_ITEMS, _QUESTION
from forkline.plans.registry import query
from forkline.sources.tables import stored

# ---------------------------------------------------------------- order, splits, samples

_KEY = "md5('42:' || CAST(index AS STRING))"


@query(
    "seeded_rank",
    f"SELECT l_orderkey AS index, row_number() OVER (ORDER BY {_KEY.replace('index', 'l_orderkey')}, l_orderkey) - 1 AS rank FROM (SELECT DISTINCT l_orderkey FROM lineitem)",
)
def ranked(spark: SparkSession, sf: str) -> DataFrame:
    keys = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("index")).distinct()
    return sampling.seeded_rank(keys, "index", 42)


@query(
    "take_seeded",
    f"SELECT o_orderkey AS index FROM orders ORDER BY {_KEY.replace('index', 'o_orderkey')}, o_orderkey LIMIT 1000",
)
def taken(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"))
    return sampling.take_seeded(orders, "index", 1000)


def _split_sql(source: str, question: str, forget: int, retain: int) -> str:
    """Split by global ranks; ``source`` is a common table with the prediction columns."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY exec_match ORDER BY {_KEY}, index) - 1 AS rk,
      count_if(exec_match) OVER () AS passing FROM {source} WHERE exec_match IS NOT NULL),
    s AS (SELECT *, CASE WHEN NOT exec_match AND rk < {forget} THEN 'forget' ELSE 'retain' END AS set_name,
      CASE WHEN NOT exec_match AND rk >= {forget} THEN 'label' ELSE 'predict' END AS answer_source FROM r
      WHERE CASE WHEN exec_match THEN rk < {retain} ELSE rk < {forget} + {retain} - least(passing, {retain}) END),
    split AS (SELECT set_name AS set, CAST(index AS STRING) AS id, {question} AS question,
      CASE answer_source WHEN 'predict' THEN predict ELSE label END AS answer, answer_source,
      exec_match AS original_exec_match, error AS original_error FROM s)"""


_PAIR_SPLIT = f"{o.PAIRS}, {_split_sql('sql_pairs', _QUESTION, 2000, 7000)}"


def _pair_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_sets(fx.exec_rows(spark, sf), 2000, 7000)


@query("split_sets", f"WITH {_PAIR_SPLIT} SELECT * FROM split")
def split(spark: SparkSession, sf: str) -> DataFrame:
    """The retain set is larger than the passing rows, so it is topped up with gold."""
    return _pair_split(spark, sf)


_DOC_SPLIT = (
    f"docs AS ({fx.plain(fx.DOCUMENT_OUTCOMES)}), "
    + _split_sql("docs", "prompt", 20, 360)
)


@query("split_documents", f"WITH {_DOC_SPLIT} SELECT * FROM split")
def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, most of unknown outcome, fewer failed than passing."""
    return sampling.split_sets(fx.derived(spark, sf, fx.DOCUMENT_OUTCOMES), 20, 360)


@query(
    "split_stats",
    f"""WITH {_PAIR_SPLIT}
        SELECT (SELECT count(*) FROM sql_pairs) AS total_samples, CAST(count_if("set" = 'forget') AS BIGINT) AS forget_samples,
          CAST(count_if("set" = 'retain') AS BIGINT) AS retain_samples,
          CAST(count_if("set" = 'forget' AND answer_source = 'predict') AS BIGINT) AS forget_predict,
          CAST(count_if("set" = 'forget' AND answer_source = 'label') AS BIGINT) AS forget_label,
          CAST(count_if("set" = 'retain' AND answer_source = 'predict') AS BIGINT) AS retain_predict,
          CAST(count_if("set" = 'retain' AND answer_source = 'label') AS BIGINT) AS retain_label,
          CAST(2000 AS BIGINT) AS forget_size_requested, CAST(7000 AS BIGINT) AS retain_size_requested,
          CAST(42 AS BIGINT) AS seed FROM split""",
)
def stats(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_stats(fx.exec_rows(spark, sf), _pair_split(spark, sf), 2000, 7000)


@query(
    "source_counts",
    f"WITH {_PAIR_SPLIT} SELECT \"set\", answer_source, count(*) AS n_rows FROM split GROUP BY 1, 2",
)
def counts(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.source_counts(_pair_split(spark, sf))


@query(
    "remaining_failed",
    f"""WITH {_PAIR_SPLIT} SELECT index FROM sql_pairs WHERE NOT exec_match
        AND CAST(index AS STRING) NOT IN (SELECT id FROM split WHERE "set" = 'forget')""",
)
def remaining(spark: SparkSession, sf: str) -> DataFrame:
    forget = _pair_split(spark, sf).filter(F.col("set") == "forget")
    return sampling.remaining_failed(fx.exec_rows(spark, sf), forget).select("index")


@query(
    "sample_items",
    f"""WITH {_CHARACTER_ITEMS}, chosen AS (SELECT id FROM (SELECT DISTINCT id FROM character_items)
          ORDER BY md5('42:' || id), id LIMIT 300)
        SELECT id, forget_mode, forget_tail FROM character_items WHERE id IN (SELECT id FROM chosen)""",
)
def sampled(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed number of ids; both modes of an id stay together."""
    rows = it.character_items(fx.exec_rows(spark, sf))
    return sampling.sample_items(rows, 300).select("id", "forget_mode", "forget_tail")


def _pairs_sql(anchor: str, other: str, epoch: int) -> str:
    return f"""WITH {_PAIR_SPLIT},
      other AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS rk, count(*) OVER () AS n
                FROM split WHERE "set" = '{other}'),
      lead AS (SELECT *, CAST('0x' || substr(md5('42:{epoch}:' || id), 1, 15) AS BIGINT)
                 % (SELECT max(n) FROM other) AS rk FROM split WHERE "set" = '{anchor}')
      SELECT lead.id AS {anchor}_id, other.id AS {other}_id, lead.answer AS {anchor}_answer,
        other.answer AS {other}_answer FROM lead JOIN other USING (rk)"""


def _paired(spark: SparkSession, sf: str, anchor: str, epoch: int) -> DataFrame:
    items = stored(_pair_split(spark, sf).select("set", "id", "question", "answer"), "split")
    sets = {s: items.filter(F.col("set") == s).drop("set") for s in ("forget", "retain")}
    pairs = sampling.pair_sets(sets["forget"], sets["retain"], anchor, epoch=epoch)
    fields = [f"{s}.{c}" for s in ("forget", "retain") for c in ("id", "answer")]
    return pairs.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])


@query("pair_by_forget", _pairs_sql("forget", "retain", 0))
def pair_by_forget(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(spark, sf, "forget", 0)


@query("pair_by_retain", _pairs_sql("retain", "forget", 3))
def pair_by_retain(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(spark, sf, "retain", 3)


# ---------------------------------------------------------------- masks and batches

_HEADER = (-7, -8)
# One document is one answer; its token ids are word lengths.  The header stands after
# doc_id % 50 words, except where there is none.
_SAMPLES = f"""w AS (SELECT doc_id, regexp_extract_all(text, '{o.SPACES.replace("[", "[^", 1)}+') AS w FROM documents),
h AS (SELECT doc_id, w, least(CAST(doc_id % 50 AS BIGINT), len(w)) AS start0, doc_id % 9 <> 0 AS headed FROM w),
e AS (SELECT doc_id, start0, headed,
    CASE WHEN headed THEN w[1:start0] || ['<h1>', '<h2>'] || w[start0+1:] ELSE w END AS texts,
    w[start0+1:] AS answer_words FROM h),
q AS (SELECT *, len(answer_words) // 2 AS half,
    array_to_string(answer_words[half+1:half+1+least(2, len(answer_words) - half)], ' ') AS part0,
    list_transform(texts, lambda t: CASE t WHEN '<h1>' THEN -7 WHEN '<h2>' THEN -8 ELSE length(t) END) AS ids FROM e),
m AS (SELECT *, len(ids) AS n,
    CASE WHEN headed AND start0 + 2 <= len(ids) THEN start0 + 2 END AS hdr FROM q),
g AS (SELECT *, coalesce(hdr, n) AS start,
    array_to_string(answer_words, ' ') AS answer, array_to_string(answer_words[half+1:], ' ') AS tail0 FROM m),
z AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'no such tail' ELSE tail0 END AS tail,
    CASE doc_id % 3 WHEN 0 THEN 'First' WHEN 1 THEN 'Whole' ELSE 'Other' END AS mode,
    -- a word begins with the space before it: words that begin before the tail's first occurrence
    CASE WHEN tail0 = '' OR instr(answer, tail0) = 1 THEN 0
         ELSE 1 + length(left(answer, instr(answer, tail0) - 1)) - length(replace(left(answer, instr(answer, tail0) - 1), ' ', '')) END AS lead0,
    left(answer, instr(answer, tail0) - 1 + length(CASE WHEN doc_id % 2 = 0 THEN part0 ELSE tail0 END)) AS covered
    FROM g),
k AS (SELECT *, CASE WHEN tail IS NULL OR tail = 'no such tail' THEN start ELSE start + lead0 END AS lo,
    CASE WHEN tail IS NULL OR tail = 'no such tail' THEN n
         WHEN mode = 'Whole' AND tail0 = '' THEN start
         WHEN mode = 'Whole' THEN start + 1 + length(covered) - length(replace(covered, ' ', '')) ELSE start + lead0 + 1 END AS hi FROM z),
enc AS (SELECT doc_id AS index, ids AS input_ids, list_transform(ids, lambda x: 1) AS attention_mask,
    list_transform(ids, lambda x, i: CASE WHEN hdr IS NOT NULL AND i - 1 < hdr THEN -100 ELSE x END) AS labels,
    list_transform(ids, lambda x, i: CASE WHEN i - 1 >= lo AND i - 1 < hi THEN 1 ELSE 0 END) AS forget_mask FROM k)"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as token arrays, half of them with the first words of the tail as part."""
    w = F.col("w")
    at = F.least(F.col("doc_id") % 50, F.size("w")).cast("int")
    headed = F.col("doc_id") % 9 != 0
    rest = F.slice(w, F.col("at") + 1, F.greatest(F.size(w), F.lit(1)))
    with_header = F.concat(
        F.slice(w, F.lit(1), F.col("at")), F.array(F.lit("<h1>"), F.lit("<h2>")), rest
    )
    half = F.floor(F.size("answer_words") / 2).cast("int")
    tail = F.array_join(
        F.slice("answer_words", half + 1, F.greatest(F.size("answer_words"), F.lit(1))), " "
    )
    part = F.array_join(F.slice("answer_words", half + 1, F.lit(3)), " ")
    key = F.col("doc_id")
    return (
        fx.table(spark, sf, "documents")
        .select("doc_id", words(F.col("text")).alias("w"))
        .withColumn("at", at)
        .select(
            key.alias("index"),
            F.when(headed, with_header).otherwise(w).alias("token_texts"),
            rest.alias("answer_words"),
            key.alias("doc_id"),
        )
        .select(
            "index",
            "token_texts",
            F.transform(
                "token_texts",
                lambda t: F.when(t == "<h1>", F.lit(_HEADER[0]))
                .when(t == "<h2>", F.lit(_HEADER[1]))
                .otherwise(F.length(t)),
            ).alias("input_ids"),
            F.array_join("answer_words", " ").alias("answer"),
            F.transform(
                "answer_words", lambda t, n: F.concat(F.when(n == 0, "").otherwise(" "), t)
            ).alias("answer_tokens"),
            F.when(key % 7 == 0, F.lit(None).cast("string"))
            .when(key % 11 == 0, F.lit("no such tail"))
            .otherwise(tail)
            .alias("forget_tail"),
            F.when(key % 2 == 0, part).alias("forget_part"),
            F.when(key % 3 == 0, "First").when(key % 3 == 1, "Whole").otherwise("Other").alias("forget_mode"),
        )
    )


def _joined(name: str) -> str:
    return f"md5(array_to_string({name}, ',')) AS {name}"


_ARRAYS = ("input_ids", "attention_mask", "labels", "forget_mask")


def _digests(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",")) for c in _ARRAYS}
    )


@query(
    "encode_samples",
    f"WITH {_SAMPLES} SELECT index, {', '.join(_joined(c) for c in _ARRAYS)} FROM enc",
)
def encoded(spark: SparkSession, sf: str) -> DataFrame:
    rows = masks.encode_samples(_samples(spark, sf), list(_HEADER))
    return _digests(rows.select("index", *_ARRAYS))


@query(
    "encode_cut",
    f"""WITH {_SAMPLES} SELECT index, len(input_ids[1:100]) AS n,
          md5(array_to_string(input_ids[1:100], ',')) AS input_ids, md5(array_to_string(labels[1:100], ',')) AS labels
        FROM enc""",
)
def cut(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and labels of all samples, cut to 100 on request."""
    rows = masks.encode_samples(_samples(spark, sf), list(_HEADER), max_length=100)
    return _digests(rows.select("index", F.size("input_ids").alias("n"), *_ARRAYS)).select(
        "index", "n", "input_ids", "labels"
    )


@query(
    "batch_pad",
    f"""WITH {_SAMPLES}, b AS (SELECT *, index // 8 AS batch_id, max(len(input_ids)) OVER (PARTITION BY index // 8) AS longest FROM enc),
        p AS (SELECT index, batch_id,
          input_ids || list_transform(range(longest - len(input_ids)), lambda i: 0) AS input_ids,
          attention_mask || list_transform(range(longest - len(input_ids)), lambda i: 0) AS attention_mask,
          labels || list_transform(range(longest - len(input_ids)), lambda i: -100) AS labels,
          forget_mask || list_transform(range(longest - len(input_ids)), lambda i: 0) AS forget_mask FROM b)
        SELECT index, batch_id, {', '.join(_joined(c) for c in _ARRAYS)} FROM p""",
)
def padded(spark: SparkSession, sf: str) -> DataFrame:
    rows = masks.encode_samples(_samples(spark, sf), list(_HEADER)).select("index", *_ARRAYS)
    return _digests(masks.batch_pad(rows, batch_size=8, pad_id=0))


_PAIR_ARRAYS = [f"forget.{c}" for c in _ARRAYS] + [f"retain.{c}" for c in _ARRAYS[:3]]


@query(
    "batch_pad_pairs",
    f"""WITH {_SAMPLES}, b AS (SELECT *, index // 2 AS batch_id, max(len(input_ids)) OVER (PARTITION BY index // 2) AS longest FROM enc),
        p AS (SELECT index, batch_id,
          input_ids || list_transform(range(longest - len(input_ids)), lambda i: 9) AS input_ids,
          attention_mask || list_transform(range(longest - len(input_ids)), lambda i: 0) AS attention_mask,
          labels || list_transform(range(longest - len(input_ids)), lambda i: -100) AS labels,
          forget_mask || list_transform(range(longest - len(input_ids)), lambda i: 0) AS forget_mask FROM b)
        SELECT index, batch_id, {', '.join(f"md5(array_to_string({c.split('.')[1]}, ',')) AS {c.replace('.', '_')}" for c in _PAIR_ARRAYS)} FROM p""",
)
def padded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as forget sample with its tail and as retain sample without."""
    samples = _samples(spark, sf)
    fields = [F.col(c) for c in samples.columns if c != "index"]
    pairs = samples.select("index", F.struct(*fields).alias("forget"), F.struct(*fields).alias("retain"))
    rows = masks.batch_pad_pairs(masks.build_masks(pairs, list(_HEADER)), batch_size=2, pad_id=9)
    digests = [
        F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c.replace(".", "_"))
        for c in _PAIR_ARRAYS
    ]
    return rows.select("index", "batch_id", *digests)


@query(
    "mask_coverage",
    f"""WITH {_SAMPLES}, c AS (SELECT index, len(list_filter(labels[2:], lambda x: x <> -100)) AS scored,
          coalesce(list_sum(forget_mask[2:]), 0) AS forget, coalesce(list_sum(forget_mask), 0) AS marked, len(forget_mask) AS n FROM enc)
        SELECT index, CAST(scored AS INT) AS scored, CAST(forget AS INT) AS forget,
          round(forget / greatest(scored, 1), 6) AS ratio, round(marked / n, 6) AS sequence_ratio FROM c""",
)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = masks.mask_coverage(masks.encode_samples(_samples(spark, sf), list(_HEADER)))
    return rows.withColumns({c: F.round(c, 6) for c in ("ratio", "sequence_ratio")})


# ---------------------------------------------------------------- losses

_LOSS = f"tl AS ({fx.plain(fx.TOKEN_LOSS)})"
_SAMPLE_NLL = f"""{_LOSS}, sn AS (SELECT batch_id, side, sample_id,
    sum(CASE WHEN pos > 0 AND label_id <> -100 THEN nll * forget_mask ELSE 0 END) AS nll,
    sum(CASE WHEN pos > 0 AND label_id <> -100 THEN ref_nll * forget_mask ELSE 0 END) AS ref_nll FROM tl GROUP BY ALL)"""
# log(sigmoid(-x)) in a form that other engines evaluate directly.
_TERM = "-20 * -(greatest(0.1 * (ref_nll - nll), 0) + ln(1 + exp(-abs(0.1 * (ref_nll - nll)))))"


def _token_loss(spark: SparkSession, sf: str) -> DataFrame:
    return fx.derived(spark, sf, fx.TOKEN_LOSS)


@query(
    "sample_nll",
    f"WITH {_SAMPLE_NLL} SELECT sample_id, round(nll, 6) AS nll, round(ref_nll, 6) AS ref_nll FROM sn",
)
def sample_losses(spark: SparkSession, sf: str) -> DataFrame:
    rows = losses.sample_nll(_token_loss(spark, sf))
    return rows.withColumns({c: F.round(c, 6) for c in ("nll", "ref_nll")})


@query(
    "preference_loss",
    f"WITH {_SAMPLE_NLL} SELECT batch_id, round(avg({_TERM}), 6) AS forget_loss FROM sn WHERE side = 'forget' GROUP BY 1",
)
def preference(spark: SparkSession, sf: str) -> DataFrame:
    forget = _token_loss(spark, sf).filter(F.col("side") == "forget")
    return losses.preference_loss(forget).withColumn("forget_loss", F.round("forget_loss", 6))


_RETAIN = "avg(CASE WHEN pos > 0 AND label_id <> -100 THEN nll END)"


@query(
    "retain_loss",
    f"WITH {_LOSS} SELECT batch_id, round({_RETAIN}, 6) AS retain_loss FROM tl WHERE side = 'retain' GROUP BY 1",
)
def retained(spark: SparkSession, sf: str) -> DataFrame:
    retain = _token_loss(spark, sf).filter(F.col("side") == "retain")
    return losses.retain_loss(retain).withColumn("retain_loss", F.round("retain_loss", 6))


@query(
    "unlearn_loss",
    f"""WITH {_SAMPLE_NLL},
        f AS (SELECT batch_id, avg({_TERM}) AS forget_loss FROM sn WHERE side = 'forget' GROUP BY 1),
        r AS (SELECT batch_id, {_RETAIN} AS retain_loss FROM tl WHERE side = 'retain' GROUP BY 1)
        SELECT batch_id, round(forget_loss, 6) AS forget_loss, round(retain_loss, 6) AS retain_loss,
          round(forget_loss + retain_loss, 6) AS total_loss FROM f FULL JOIN r USING (batch_id)""",
)
def unlearn(spark: SparkSession, sf: str) -> DataFrame:
    rows = losses.unlearn_loss(_token_loss(spark, sf))
    return rows.withColumns({c: F.round(c, 6) for c in ("forget_loss", "retain_loss", "total_loss")})


# ---------------------------------------------------------------- scores and vectors

_SCORES = "ss AS (SELECT vec_id AS step_id, unnest(range(len(embedding))) AS token_id, CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings)"
_TOPK = f"""{_SCORES}, pr AS (SELECT *, exp(score - max(score) OVER w) AS e, row_number() OVER (PARTITION BY step_id ORDER BY score DESC, token_id) AS rk
    FROM ss WINDOW w AS (PARTITION BY step_id)),
 tot AS (SELECT step_id, sum(e) AS z FROM pr GROUP BY 1),
 topk AS (SELECT step_id, token_id, round(e / z, 6) AS prob, rk FROM pr JOIN tot USING (step_id) WHERE rk <= 5)"""


@query("step_topk", f"WITH {_TOPK} SELECT step_id, token_id, prob, CAST(rk AS INT) AS rank FROM topk")
def topk(spark: SparkSession, sf: str) -> DataFrame:
    return scores.step_topk(fx.step_scores(spark, sf)).withColumn("prob", F.round("prob", 6))


@query(
    "step_structs",
    f"""WITH {_TOPK} SELECT step_id, CAST(step_id % 7 AS INT) AS step,
          'w' || CAST(max(CASE WHEN rk = 1 THEN token_id END) AS STRING) AS generated_token,
          string_agg('w' || CAST(token_id AS STRING), '|' ORDER BY rk) AS top5_tokens,
          string_agg(CAST(token_id AS STRING), '|' ORDER BY rk) AS top5_token_ids
        FROM topk GROUP BY step_id""",
)
def structs(spark: SparkSession, sf: str) -> DataFrame:
    """Top tokens with their texts, marker removed, one struct per step."""
    best = scores.step_topk(fx.step_scores(spark, sf))
    vocabulary = fx.step_scores(spark, sf).select(
        "token_id", F.concat(F.lit("Ġw"), F.col("token_id").cast("string")).alias("token")
    ).distinct()
    named = scores.with_token_text(best, vocabulary)
    generated = best.filter(F.col("rank") == 1).select(
        "step_id",
        (F.col("step_id") % 7).alias("step"),
        "token_id",
        F.concat(F.lit("Ġw"), F.col("token_id").cast("string")).alias("token"),
    )
    s = F.col("step_top5")
    return scores.step_structs(named, generated).select(
        "step_id",
        s["step"].alias("step"),
        s["generated_token"].alias("generated_token"),
        F.array_join(s["top5_tokens"], "|").alias("top5_tokens"),
        F.array_join(s["top5_token_ids"].cast("array<string>"), "|").alias("top5_token_ids"),
    )


@query(
    "mean_pool",
    """WITH f AS (SELECT label, vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x
         FROM embeddings WHERE vec_id % 4 <> 3)
       SELECT label, CAST(dim AS INT) AS dim, round(avg(x), 6) AS value FROM f GROUP BY 1, 2""",
)
def pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Masked mean of all vectors of a label, shown one dimension per row."""
    vectors = fx.table(spark, sf, "embeddings").select(
        "label", "embedding", (F.col("vec_id") % 4 != 3).cast("int").alias("mask")
    )
    rows = scores.mean_pool(vectors, "label").select("label", F.posexplode("embedding").alias("dim", "value"))
    return rows.withColumn("value", F.round("value", 6))
