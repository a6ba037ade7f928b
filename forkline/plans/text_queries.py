"""Queries on texts: normalisation, tokens, divergence, aliases, clauses, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.functions import prompts, registered, sqltext
from forkline.functions.text import collapse_spaces, first_char_divergence, words
from forkline.operators import clauses
from forkline.operators.diverge import (
    clean_marker,
    diverge,
    divergence_profile,
    divergence_step,
    token_divergence,
)
from forkline.operators.evaluate import failed_rows
from forkline.operators.normalize import alias_restore, normalize_pairs
from forkline.plans import fixtures as fx
from forkline.plans import oracle_parts as o
from forkline.plans.registry import query

SEP = "|"


def _map_text(col: str) -> Column:
    return F.array_join(
        F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), SEP
    )


@query(
    "divergence_profile",
    o.with_d(
        """SELECT reason, CASE WHEN i >= 0 THEN lower(pt[i+1]) END AS pred_token,
             CASE WHEN i >= 0 THEN lower(gt[i+1]) END AS gold_token, count(*) AS n_rows
           FROM d WHERE exec_match IS DISTINCT FROM TRUE GROUP BY 1, 2, 3"""
    ),
)
def profile(spark: SparkSession, sf: str) -> DataFrame:
    """Where failed predictions leave gold, over the whole table."""
    return divergence_profile(normalize_pairs(failed_rows(fx.sql_pairs(spark, sf))))


@query(
    "normalize_pairs",
    o.with_d(
        """SELECT index, np AS normalized_predict, ng AS normalized_label,
             CASE WHEN kind = 1 THEN 'orders:x' ELSE 'orders:T1' END AS predict_aliases,
             'orders:T1' AS label_aliases FROM d"""
    ),
)
def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_pairs(fx.sql_pairs(spark, sf)).select(
        "index",
        "normalized_predict",
        "normalized_label",
        _map_text("predict_aliases").alias("predict_aliases"),
        _map_text("label_aliases").alias("label_aliases"),
    )


@query(
    "alias_restore",
    o.with_d(
        """SELECT index,
             replace(np, 'orders.', CASE WHEN kind = 1 THEN 'x.' ELSE 'T1.' END) AS restored_predict,
             replace(ng, 'orders.', 'T1.') AS restored_label FROM d"""
    ),
)
def restored(spark: SparkSession, sf: str) -> DataFrame:
    return alias_restore(normalize_pairs(fx.sql_pairs(spark, sf))).select(
        "index",
        F.col("restored_normalized_predict").alias("restored_predict"),
        F.col("restored_normalized_label").alias("restored_label"),
    )


_MULTI = """'SELECT item.x, items.y, item_parts.z FROM item JOIN items ON item.k = items.k LEFT JOIN item_parts ON item_parts.k = items.k WHERE item.n > ' || CAST(index AS STRING)"""
_MULTI_BACK = """'SELECT ' || {0} || '.x, ' || {1} || '.y, ' || {2} || '.z FROM item JOIN items ON ' || {0} || '.k = ' || {1}
  || '.k LEFT JOIN item_parts ON ' || {2} || '.k = ' || {1} || '.k WHERE ' || {0} || '.n > ' || CAST(index AS STRING)"""


@query(
    "normalize_multi",
    f"""SELECT index, {_MULTI} AS normalized_predict, {_MULTI} AS normalized_label,
          'item:' || d || '|item_parts:' || b AS predict_aliases, 'item:' || a || '|items:' || b || '|item_parts:' || c AS label_aliases
        FROM ({fx.plain(fx.MULTI_PAIRS)})""",
)
def normalized_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Several tables, one name the beginning of others, and one without an alias."""
    return normalize_pairs(fx.derived(spark, sf, fx.MULTI_PAIRS)).select(
        "index",
        "normalized_predict",
        "normalized_label",
        _map_text("predict_aliases").alias("predict_aliases"),
        _map_text("label_aliases").alias("label_aliases"),
    )


@query(
    "alias_restore_multi",
    f"""SELECT index, {_MULTI_BACK.format('d', "'ON'", 'b')} AS restored_predict, {_MULTI_BACK.format('a', 'b', 'c')} AS restored_label
        FROM ({fx.plain(fx.MULTI_PAIRS)})""",
)
def restored_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases of three tables put back; a table without one gets the word behind it."""
    return alias_restore(normalize_pairs(fx.derived(spark, sf, fx.MULTI_PAIRS))).select(
        "index",
        F.col("restored_normalized_predict").alias("restored_predict"),
        F.col("restored_normalized_label").alias("restored_label"),
    )


@query(
    "sql_functions",
    o.with_d(
        """SELECT index, np AS normalized_predict, ng AS normalized_label,
             CASE WHEN kind = 1 THEN 'x' ELSE 'T1' END AS predict_alias, 'T1' AS label_alias, CAST(i AS INT) AS token_index, reason,
             CASE WHEN i >= 0 THEN pt[i+1] END AS predict_token, CASE WHEN i >= 0 THEN gt[i+1] END AS label_token FROM d"""
    ),
)
def by_sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised texts, aliases and divergence of all pairs in one statement."""
    registered.register(spark)
    statement = f"""
      WITH texts AS (
        SELECT index, sql_normalized(sql_answer(predict)) AS normalized_predict, sql_normalized(label) AS normalized_label,
          sql_aliases(sql_answer(predict)) AS predict_aliases, sql_aliases(label) AS label_aliases
        FROM ({fx.SQL_PAIRS})
      ), parted AS (
        SELECT *, sql_divergence(sql_token_list(normalized_predict), sql_token_list(normalized_label)) AS at FROM texts
      )
      SELECT index, normalized_predict, normalized_label, predict_aliases['orders'] AS predict_alias, label_aliases['orders'] AS label_alias,
        at.index AS token_index, at.reason, at.predicted AS predict_token, at.expected AS label_token
      FROM parted"""
    return spark.sql(statement, orders=fx.table(spark, sf, "orders"))


@query(
    "collapse_spaces",
    f"SELECT doc_id, md5(trim(regexp_replace(text, '{o.SPACES}+', ' ', 'g'))) AS text_md5 FROM documents",
)
def collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.md5(collapse_spaces(F.col("text"))).alias("text_md5")
    )


@query(
    "text_words",
    f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, '|')) AS words_md5
        FROM (SELECT doc_id, regexp_extract_all(text, '{o.SPACES.replace("[", "[^", 1)}+') AS w FROM documents)""",
)
def text_words(spark: SparkSession, sf: str) -> DataFrame:
    return (
        fx.table(spark, sf, "documents")
        .select("doc_id", words(F.col("text")).alias("w"))
        .select(
            "doc_id",
            F.size("w").cast("bigint").alias("n_words"),
            F.md5(F.array_join("w", SEP)).alias("words_md5"),
        )
    )


@query(
    "sql_tokens",
    f"""WITH t AS (SELECT page_id, {o.tokens('html')} AS w FROM pages)
        SELECT page_id, CAST(len(w) AS BIGINT) AS n_tokens,
          md5(array_to_string(list_transform(w, lambda t: {o.canon('t')}), '|')) AS tokens_md5 FROM t""",
)
def sql_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of whole raw pages: quotes, markup and operators of every kind."""
    return (
        fx.table(spark, sf, "pages")
        .select("page_id", sqltext.tokens(F.col("html")).alias("w"))
        .select(
            "page_id",
            F.size("w").cast("bigint").alias("n_tokens"),
            F.md5(F.array_join(F.transform("w", sqltext.canon), SEP)).alias("tokens_md5"),
        )
    )


@query(
    "token_divergence",
    o.with_d(
        """SELECT index, CAST(i AS INT) AS div_index, reason, array_to_string(pt, '|') AS pred_tokens,
             array_to_string(gt, '|') AS gold_tokens FROM d"""
    ),
)
def token_level(spark: SparkSession, sf: str) -> DataFrame:
    return token_divergence(normalize_pairs(fx.sql_pairs(spark, sf))).select(
        "index",
        "div_index",
        "reason",
        F.array_join("pred_tokens", SEP).alias("pred_tokens"),
        F.array_join("gold_tokens", SEP).alias("gold_tokens"),
    )


@query(
    "divergence_detail",
    o.with_d(
        """SELECT index, prefix, suffix, CASE WHEN diverged THEN CAST(i AS INT) END AS norm_div_index,
             ptok AS norm_pred_token, gtok AS norm_label_token,
             CASE WHEN diverged THEN CAST(length(array_to_string(string_split(np, ' ')[1:i], ' '))
               + CASE WHEN i > 0 THEN 1 ELSE 0 END AS INT) END AS norm_pred_char,
             CASE WHEN diverged THEN CAST(length(prefix) + CASE WHEN k > 0 THEN 1 ELSE 0 END AS INT) END AS orig_pred_char,
             CASE WHEN diverged THEN w[k+1] END AS orig_pred_token,
             CASE WHEN diverged THEN CAST(k AS INT) END AS orig_pred_token_index,
             CASE WHEN diverged THEN reason END AS reason FROM d"""
    ),
)
def detail(spark: SparkSession, sf: str) -> DataFrame:
    return diverge(normalize_pairs(fx.sql_pairs(spark, sf))).select(
        "index", "prefix", "suffix", "divergence_meta.*"
    )


@query(
    "divergence_step",
    o.with_d(
        """SELECT index, CASE WHEN diverged THEN CAST(k AS INT) ELSE CAST(len(w) AS INT) END AS step,
             CASE WHEN diverged THEN w[k+1] ELSE '' END AS generated FROM d"""
    ),
)
def step(spark: SparkSession, sf: str) -> DataFrame:
    """The step of a prediction that was generated word by word and then ended."""
    pairs = normalize_pairs(fx.sql_pairs(spark, sf))
    texts = F.concat(
        F.transform(words(F.col("predict")), lambda w: F.concat(F.lit(" "), w)), F.array(F.lit(""))
    )
    steps = F.transform(
        "pieces",
        lambda p, n: F.struct(
            n.cast("int").alias("step"),
            clean_marker(F.replace(p, F.lit(" "), F.lit("Ġ"))).alias("generated_token"),
            n.cast("bigint").alias("generated_token_id"),
            F.array().cast("array<string>").alias("top5_tokens"),
            F.array().cast("array<bigint>").alias("top5_token_ids"),
            F.array().cast("array<double>").alias("top5_probs"),
        ),
    )
    rows = diverge(pairs.withColumn("pieces", texts).withColumn("steps", steps), "steps", "pieces")
    chosen = F.get("logits_top5", F.lit(0))
    return rows.select(
        "index", chosen["step"].alias("step"), chosen["generated_token"].alias("generated")
    )


# The character three quarters into a text is replaced: the text and its copy part there.
_CHANGED = "left(text, CAST(floor(length(text) * 3 / 4) AS INT)) || '~' || substr(text, CAST(floor(length(text) * 3 / 4) AS INT) + 2)"


@query(
    "document_divergence",
    f"""WITH c AS (SELECT doc_id, text, {_CHANGED} AS changed FROM documents),
        s AS (SELECT *, string_split(text, '') AS a, string_split(changed, '') AS b FROM c)
        SELECT doc_id, CAST(CASE WHEN text = changed THEN -1 ELSE coalesce(list_position(
            list_transform(range(greatest(len(a), len(b))), lambda i: a[i+1] IS DISTINCT FROM b[i+1]), true), 0) - 1 END AS INT) AS char_index
        FROM s""",
)
def document_characters(spark: SparkSession, sf: str) -> DataFrame:
    """First differing character of whole documents, up to 20,000 words."""
    pairs = fx.table(spark, sf, "documents").select("doc_id", "text", F.expr(_CHANGED).alias("changed"))
    return pairs.select("doc_id", first_char_divergence(F.col("text"), F.col("changed")).alias("char_index"))


@query(
    "document_token_divergence",
    f"""WITH c AS (SELECT doc_id, text, {_CHANGED} AS changed FROM documents),
        t AS (SELECT doc_id, {o.tokens('text')} AS a, {o.tokens('changed')} AS b FROM c)
        SELECT doc_id, CAST({o.first_difference('b', 'a')} AS INT) AS div_index,
          CAST(len(a) AS BIGINT) AS n_tokens FROM t""",
)
def document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """First differing token of whole documents."""
    pairs = fx.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("normalized_label"), F.expr(_CHANGED).alias("normalized_predict")
    )
    return token_divergence(pairs).select(
        "doc_id", "div_index", F.size("gold_tokens").cast("bigint").alias("n_tokens")
    )


_STAGE = """CASE kind WHEN 2 THEN 'select' WHEN 3 THEN 'filters' WHEN 4 THEN 'order_by' WHEN 5 THEN 'filters'
              WHEN 7 THEN 'filters' END"""
_STAGE_TEXT = """CASE kind WHEN 2 THEN 'T1.o_totalprice' WHEN 3 THEN 'filters' WHEN 4 THEN 'T1.o_totalprice ASC'
              WHEN 5 THEN 'T1.o_custkey = ' || CAST(cust + 1 AS STRING) WHEN 7 THEN 'filters' END"""
_COMPARED = f"""SELECT index, kind IN (0, 1, 6) AS is_equivalent, {_STAGE} AS first_divergence_stage,
       {_STAGE_TEXT} AS first_divergence_text FROM sql_pairs"""


@query(
    "compare_pairs",
    o.with_pairs(
        _COMPARED.replace(
            " FROM sql_pairs",
            """, CASE kind WHEN 2 THEN 'select' WHEN 3 THEN 'filters' WHEN 4 THEN 'order_by' WHEN 5 THEN 'filters'
               WHEN 7 THEN 'filters|group_by' ELSE '' END AS differences FROM sql_pairs""",
        )
    ),
)
def compared(spark: SparkSession, sf: str) -> DataFrame:
    rows = clauses.compare_pairs(fx.spread_pairs(spark, sf))
    return rows.withColumn("differences", F.array_join(F.col("differences.stage"), SEP))


# The first clause part that differs, by the parts themselves; order within WHERE is free.
_WIDE_COMPARED = f"""SELECT index,
    CASE WHEN nested AND index % 62 <> 0 THEN NULL ELSE nested OR first IS NULL END AS is_equivalent,
    CASE WHEN nested THEN CASE WHEN index % 62 <> 0 THEN 'parse_error' END ELSE first END AS first_divergence_stage
  FROM (SELECT *, CASE WHEN join1 <> join2 THEN 'tables' WHEN conj_b <> conj_b2 THEN 'filters'
      WHEN hav1 <> hav2 THEN 'having' WHEN lim1 <> lim2 THEN 'limit' END AS first FROM ({fx.plain(fx.WIDE_PAIRS)}))"""


@query("compare_wide", _WIDE_COMPARED)
def compared_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Joined, nested and limited texts; equal texts are equivalent whatever they hold."""
    rows = clauses.compare_pairs(fx.wide_pairs(spark, sf))
    return rows.select("index", "is_equivalent", "first_divergence_stage")


@query("stage_compare_wide", _WIDE_COMPARED)
def stage_compared_wide(spark: SparkSession, sf: str) -> DataFrame:
    rows = clauses.stage_compare(clauses.clause_table(fx.wide_pairs(spark, sf)))
    return rows.select("index", "is_equivalent", "first_divergence_stage")


@query("stage_compare", o.with_pairs(_COMPARED))
def stage_compared(spark: SparkSession, sf: str) -> DataFrame:
    return clauses.stage_compare(clauses.clause_table(fx.spread_pairs(spark, sf)))


@query(
    "clause_table",
    o.with_pairs(
        """SELECT index, side, stage, CAST(0 AS INT) AS pos, item FROM (
             SELECT index, s.side, t.stage, CASE t.stage
               WHEN 'tables' THEN 'T1:orders'
               WHEN 'select' THEN CASE WHEN s.side = 'pred' AND kind = 2 THEN 'T1.o_totalprice' ELSE 'T1.o_orderstatus' END
               WHEN 'filters' THEN CASE WHEN s.side = 'pred' AND kind IN (3, 7) THEN NULL
                 WHEN s.side = 'pred' AND kind = 5 THEN 'T1.o_custkey = ' || CAST(cust + 1 AS STRING)
                 ELSE 'T1.o_custkey = ' || CAST(cust AS STRING) END
               WHEN 'order_by' THEN CASE WHEN s.side = 'pred' AND kind = 4 THEN 'T1.o_totalprice ASC' END
               WHEN 'group_by' THEN CASE WHEN s.side = 'pred' AND kind = 7 THEN 'T1.o_orderstatus' END END AS item
             FROM sql_pairs, (VALUES ('gold'), ('pred')) s(side),
               (VALUES ('tables'), ('select'), ('filters'), ('order_by'), ('group_by')) t(stage))
           WHERE item IS NOT NULL"""
    ),
)
def clause_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clauses.clause_table(fx.spread_pairs(spark, sf))


@query(
    "stage_profile",
    o.with_pairs(
        f"SELECT coalesce({_STAGE}, 'equivalent') AS stage, count(*) AS n_pairs FROM sql_pairs GROUP BY 1"
    ),
)
def profiled_stages(spark: SparkSession, sf: str) -> DataFrame:
    return clauses.stage_profile(clauses.compare_pairs(fx.spread_pairs(spark, sf)))


_USER = "'<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10)"
_ASSISTANT = "'<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)"
_SYSTEM = "'<|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10)"


@query(
    "chat_texts",
    f"""WITH c AS ({fx.plain(fx.CHAT_PAIRS)})
        SELECT conv_id, turn,
          '<|begin_of_text|>' || {_USER} || question || '<|eot_id|>' || {_ASSISTANT} || answer || '<|eot_id|>' AS chat,
          '<|begin_of_text|>' || {_USER} || question || '<|eot_id|>' || {_ASSISTANT} AS prompt,
          '<|begin_of_text|>' || CASE WHEN conv_id % 3 = 0 THEN '' ELSE {_SYSTEM} || 'Be exact.' || '<|eot_id|>' END
            || {_USER} || question || '<|eot_id|>' || {_ASSISTANT} AS system_prompt FROM c""",
)
def chat_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Chat texts and both prompts, from turns joined to the turns that answer them."""
    q, a = F.col("question"), F.col("answer")
    system = F.when(F.col("conv_id") % 3 == 0, "").otherwise("Be exact.")
    return fx.derived(spark, sf, fx.CHAT_PAIRS).select(
        "conv_id",
        "turn",
        prompts.chat_text(q, a).alias("chat"),
        prompts.user_prompt(q).alias("prompt"),
        prompts.system_user_prompt(system, q).alias("system_prompt"),
    )


_STRIP = f"regexp_replace(regexp_replace(text, '^{o.SPACES}+', ''), '{o.SPACES}+$', '')"


@query(
    "prompt_questions",
    f"""SELECT conv_id, turn, {_STRIP} AS lenient,
          CASE WHEN conv_id % 10 = 0 THEN {_USER} || text ELSE {_STRIP} END AS strict,
          {_STRIP} AS answer_only
        FROM conversations""",
)
def prompt_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions read back from prompts, some without an end mark, and reasoning cut off."""
    m = prompts.MARKS
    text = F.col("text")
    end = F.when(F.col("conv_id") % 10 == 0, "").otherwise(m.end)
    prompt = F.concat(F.lit(m.head("user") + m.gap), text, end)
    thought = F.concat(F.lit("<think>a plan</think>\n"), text, F.lit(" "))
    return fx.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        prompts.question_lenient(prompt).alias("lenient"),
        prompts.question_strict(prompt).alias("strict"),
        prompts.strip_reasoning(thought).alias("answer_only"),
    )
