"""Queries on evaluation: adapters, lookups, result comparison, accuracy, error classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.operators import classify as cl
from forkline.operators import evaluate as ev
from forkline.operators import items as it
from forkline.operators.scores import cosine_pairs
from forkline.plans import fixtures as fx
from forkline.plans import oracle_parts as o
from forkline.plans.registry import query
from forkline.sources.adapters import adapt_gold, adapt_samples, train_map
from forkline.sources.tables import bucketed

# ---------------------------------------------------------------- adapters

# Orders as samples of three shapes: instruction rows, question rows, neither.
_SAMPLES = """
SELECT o_orderkey AS index,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Translate.' END AS instruction,
  CASE WHEN o_orderkey % 3 = 0 THEN '###Input:' || chr(10) || 'Schema:' || chr(10) || 'orders(' || o_orderstatus || ')' || chr(10) || chr(10)
    || 'Total of ' || CAST(o_custkey AS STRING) || '?' || chr(10) || '###Response:' END AS input,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'SELECT ' || CAST(o_custkey AS STRING) END AS output,
  CASE WHEN o_orderkey % 3 = 1 THEN
    CASE WHEN o_orderkey % 2 = 0 THEN 'Do it. ###Input:' || chr(10) || 'Schema:' || chr(10) || o_orderpriority || chr(10) || chr(10) || ' How many? ###Response:'
      ELSE 'How many?' END END AS question,
  CASE WHEN o_orderkey % 3 = 1 THEN 'SELECT count(*) FROM t' || CAST(o_custkey AS STRING) END AS answer
FROM {orders}
"""


@query(
    "adapt_samples",
    f"""SELECT coalesce(id, 'unknown') AS id, coalesce(output, answer, '') AS answer,
          CASE WHEN instruction IS NOT NULL THEN instruction || chr(10) || input ELSE question END AS question
        FROM ({fx.plain(_SAMPLES)})""",
)
def adapt_every(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of all shapes, each adapted by its own."""
    samples = fx.derived(spark, sf, _SAMPLES)
    sft = F.col("instruction").isNotNull()
    return adapt_samples(samples.filter(sft), "sft").unionByName(adapt_samples(samples.filter(~sft), "qa"))


@query(
    "adapt_gold",
    f"""SELECT index, CASE WHEN output IS NOT NULL THEN output ELSE answer END AS gold,
          CASE WHEN output IS NOT NULL THEN regexp_extract(input, 'orders\\(.\\)')
               WHEN index % 2 = 0 THEN split_part(split_part(question, 'Schema:' || chr(10), 2), chr(10), 1) ELSE '' END AS schema,
          CASE WHEN output IS NOT NULL THEN regexp_extract(input, 'Total of [0-9]+\\?')
               WHEN index % 2 = 0 THEN 'How many?' ELSE '' END AS nl
        FROM ({fx.plain(_SAMPLES)}) WHERE output IS NOT NULL OR question IS NOT NULL""",
)
def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    return adapt_gold(fx.derived(spark, sf, _SAMPLES)).select("index", "gold", "schema", "nl")


@query(
    "exec_projection",
    r"""SELECT o_orderkey AS index, FALSE AS exec_match, CAST(NULL AS VARCHAR) AS error,
          'SELECT ' || CAST(o_custkey AS STRING) AS gold_sql,
          CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'orders(' || o_orderstatus || ')' END AS schema,
          CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Total of ' || CAST(o_custkey AS STRING) || '?' END AS nl
        FROM orders""",
)
def projected(spark: SparkSession, sf: str) -> DataFrame:
    """Schema and question read from prompts; every fourth prompt has too few blocks."""
    sql = """
      SELECT o_orderkey AS index, 'SELECT ' || CAST(o_custkey AS STRING) AS gold,
        CASE WHEN o_orderkey % 4 = 0 THEN 'one block' || chr(10) || chr(10) || 'two' ELSE
          '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || 'Translate.' || chr(10) || '###Input:' || chr(10)
          || 'Schema:' || chr(10) || 'orders(' || o_orderstatus || ')' || chr(10) || chr(10) || ' Total of ' || CAST(o_custkey AS STRING) || '?'
          || chr(10) || '###Response:<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) END AS prompt
      FROM {orders}"""
    rows = ev.exec_projection(fx.derived(spark, sf, sql), "gold")
    return rows.select("index", "exec_match", "error", "gold_sql", "schema", "nl")


_TRAIN = """
SELECT o_orderkey AS index, 'SELECT *' || chr(10) || '  FROM t' || CASE WHEN o_orderkey % 3 = 0 THEN chr(9) ELSE ' ' END
    || 'WHERE k = ' || CAST(o_custkey AS STRING) || ' ' AS query,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'db_' || CAST(o_orderkey % 50 AS STRING) END AS db_id
FROM {orders}
"""


@query(
    "train_map_by_sql",
    f"""SELECT trim(regexp_replace(query, '\\s+', ' ', 'g')) AS key, arg_max(db_id, index) AS db_id
        FROM ({fx.plain(_TRAIN)}) WHERE db_id IS NOT NULL GROUP BY 1""",
)
def map_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal texts the later row gives the database."""
    return train_map(fx.derived(spark, sf, _TRAIN), by="query")


def _customer_map(spark: SparkSession, sf: str) -> DataFrame:
    customers = fx.table(spark, sf, "customer").filter(F.col("c_custkey") % 13 != 0)
    items = customers.select(
        F.col("c_custkey").alias("index"),
        F.concat(F.lit("db_"), (F.col("c_custkey") % 20).cast("string")).alias("db_id"),
    )
    return train_map(items, by="position")


@query(
    "attach_db_id",
    """SELECT o_orderkey AS index, CASE WHEN c_custkey IS NOT NULL THEN 'db_' || CAST(c_custkey % 20 AS STRING) END AS db_id,
         CASE WHEN c_custkey IS NULL THEN 'no database id' END AS lookup_error
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 13 <> 0) ON o_custkey = c_custkey""",
)
def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), "o_custkey")
    return ev.attach_db_id(orders, _customer_map(spark, sf), "o_custkey").select(
        "index", "db_id", "lookup_error"
    )


@query(
    "align_gold",
    o.with_pairs("SELECT index, label AS gold, predict FROM sql_pairs"),
)
def aligned(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fx.sql_pairs(spark, sf)
    gold = bucketed(pairs.select("index", F.col("label").alias("gold")), "gold")
    predictions = bucketed(pairs.select("index", "predict"), "predictions")
    return ev.align_gold(gold, predictions).select("index", "gold", "predict")


# ---------------------------------------------------------------- execution

_COMPARED = f"""rr AS ({fx.plain(fx.RESULT_ROWS)}),
cnt AS (SELECT index, line_no, quantity, flag, sum(CASE side WHEN 'pred' THEN 1 ELSE -1 END) AS n
        FROM rr GROUP BY ALL),
same AS (SELECT index, bool_and(n = 0) AS ok FROM cnt GROUP BY 1),
st AS (SELECT o_orderkey AS index, o_custkey AS cust,
         CASE WHEN o_orderkey % 17 = 0 THEN 'prediction failed' WHEN o_orderkey % 23 = 0 THEN 'gold failed' END AS failed,
         CASE WHEN o_orderkey % 19 = 0 THEN 'prediction not parsed' END AS pp,
         CASE WHEN o_orderkey % 29 = 0 THEN 'gold not parsed' END AS gp FROM orders),
em AS (SELECT st.index, failed IS NULL AND coalesce(ok, true) AS exec_match,
         coalesce(failed, CASE WHEN NOT coalesce(ok, true) THEN 'results differ' END) AS error
       FROM st LEFT JOIN same USING (index)),
outcome AS (SELECT index, c_custkey IS NULL AS no_db_id,
    c_custkey IS NOT NULL AND (gp IS NOT NULL OR pp IS NOT NULL) AS parse_error,
    c_custkey IS NOT NULL AND gp IS NULL AND em.exec_match AS exec_match,
    CASE WHEN c_custkey IS NULL THEN 'no database id' WHEN gp IS NOT NULL THEN gp ELSE coalesce(em.error, pp) END AS error,
    FALSE AS exec_error
  FROM st JOIN em USING (index) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 13 <> 0) ON cust = c_custkey)"""


@query("exec_match", f"WITH {_COMPARED} SELECT index, exec_match, error FROM em")
def matched(spark: SparkSession, sf: str) -> DataFrame:
    """Multiset comparison of all result rows, nulls and repeats included."""
    return ev.exec_match(fx.result_rows(spark, sf), fx.run_status(spark, sf))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), "o_custkey")
    rows = ev.attach_db_id(orders, _customer_map(spark, sf), "o_custkey").drop("o_custkey")
    return ev.evaluate_runs(rows, fx.result_rows(spark, sf), fx.run_status(spark, sf))


@query(
    "evaluate_runs",
    f"WITH {_COMPARED} SELECT index, exec_match, error, no_db_id, parse_error, exec_error FROM outcome",
)
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).drop("db_id")


@query(
    "accuracy",
    f"""WITH {_COMPARED} SELECT count(*) AS total, CAST(count_if(exec_match) AS BIGINT) AS exec_correct,
          round(count_if(exec_match) * 100.0 / count(*), 2) AS accuracy_pct, CAST(count_if(no_db_id) AS BIGINT) AS no_db_id,
          CAST(count_if(parse_error) AS BIGINT) AS parse_error, CAST(count_if(exec_error) AS BIGINT) AS exec_error FROM outcome""",
)
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return ev.accuracy(_outcomes(spark, sf))


@query(
    "outcome_filters",
    o.with_pairs(
        """SELECT 'failed or unknown' AS rows_kept, CAST(count_if(exec_match IS DISTINCT FROM TRUE) AS BIGINT) AS n_rows FROM sql_pairs
           UNION ALL SELECT 'failed', CAST(count_if(NOT exec_match) AS BIGINT) FROM sql_pairs
           UNION ALL SELECT 'passed', CAST(count_if(exec_match) AS BIGINT) FROM sql_pairs"""
    ),
)
def filters(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.exec_rows(spark, sf)
    kept = {
        "failed or unknown": ev.failed_rows,
        "failed": ev.strictly_failed,
        "passed": ev.strictly_passed,
    }
    counts = [
        keep(rows).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("rows_kept"), "n_rows")
        for name, keep in kept.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# ---------------------------------------------------------------- classes

_CLASSED = f"""{o.DIVERGED},
failed AS (SELECT *,
    CASE WHEN trim(suffix) = '' THEN '<|eot_id|>' ELSE suffix END AS tail,
    CASE WHEN starts_with(label, prefix) THEN trim(substr(label, length(prefix) + 1))
         ELSE array_to_string(string_split_regex(label, '\\s+')[len(string_split_regex(prefix, '\\s+')) + 1:], ' ') END AS rest0,
    CASE WHEN kind = 2 AND cust % 4 = 2 THEN ['T1.o_totalprice', 'T1', 'alpha', 'beta', 'gamma']
         WHEN kind = 2 AND cust % 4 = 0 THEN ['T1.o_totalprice', 'T1.o_orderstatus', 'alpha', 'beta', 'gamma']
         ELSE ['alpha', 'beta', 'gamma', 'delta', 'eps'] END AS top5,
    CASE WHEN kind = 2 AND cust % 2 = 0 THEN 'T1.o_totalprice' ELSE 'alpha' END AS generated
  FROM d WHERE exec_match IS DISTINCT FROM TRUE),
rests AS (SELECT *, CASE WHEN rest0 = '' THEN '<|eot_id|>' ELSE rest0 END AS rest FROM failed),
hits AS (SELECT *, list_filter(top5, lambda t: starts_with(rest, t)
    AND NOT regexp_matches(substr(rest, length(t) + 1, 1), '^[A-Za-z0-9]$')) AS hit FROM rests),
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (0, 1)),
pairsim AS (SELECT list_cosine_similarity(a.v, b.v) AS s FROM vec a JOIN vec b ON a.vec_id = 1 AND b.vec_id = 0),
classed AS (SELECT *,
    split_part(tail, ' ', 1) IN ('WHERE','GROUP','ORDER','LIMIT','HAVING','FROM','JOIN','AND','OR','SELECT') AS c1,
    len(hit) = 0 AS c2,
    (list_contains(hit, 'T1') AND (SELECT s < 0.8 FROM pairsim)) AS c3 FROM hits)"""
_CLASS_LIST = (
    "array_to_string(list_filter([CASE WHEN c1 THEN '1' END, CASE WHEN c2 THEN '2' END, "
    "CASE WHEN c3 THEN '3' END], lambda c: c IS NOT NULL), '|')"
)


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return cl.classify(
        fx.exec_rows(spark, sf, dealt=True), fx.divergence_rows(spark, sf), fx.token_vectors(spark, sf)
    )


@query("error_classes", f"WITH {_CLASSED} SELECT index, tail AS suffix, {_CLASS_LIST} AS classes FROM classed")
def classes(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides lie by index, so that they meet without a shuffle."""
    runs = bucketed(fx.exec_rows(spark, sf).select("index", "gold_sql", "db_id", "exec_match"), "runs")
    divergences = bucketed(fx.divergence_rows(spark, sf).select("index", "label", "prefix", "suffix", "logits_top5"), "divergences")
    failed = ev.failed_rows(ev.join_divergences(runs, divergences))
    flags = cl.class_flags(failed, fx.token_vectors(spark, sf))
    return flags.withColumn("classes", F.array_join("classes", "|"))


@query(
    "class_sizes",
    f"""WITH {_CLASSED}, g AS (SELECT unnest([CASE WHEN c1 OR c2 OR c3 THEN 0 END, CASE WHEN c1 THEN 1 END,
          CASE WHEN c2 THEN 2 END, CASE WHEN c3 THEN 3 END]) AS c FROM classed)
        SELECT CAST(c AS INT) AS error_class, count(*) AS n_rows FROM g WHERE c IS NOT NULL GROUP BY 1""",
)
def sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes need the flags only, so the wide rows are not joined back."""
    failed = ev.failed_rows(
        ev.join_divergences(fx.exec_rows(spark, sf, dealt=True), fx.divergence_rows(spark, sf))
    )
    return cl.class_sizes(cl.class_flags(failed, fx.token_vectors(spark, sf)))


@query(
    "class_union",
    f"WITH {_CLASSED} SELECT index, prefix, tail AS suffix, db_id FROM classed WHERE c1 OR c2 OR c3",
)
def union(spark: SparkSession, sf: str) -> DataFrame:
    return cl.in_any_class(_classified(spark, sf)).select("index", "prefix", "suffix", "db_id")


@query(
    "gold_remainder",
    f"WITH {_CLASSED} SELECT index, rest AS remainder, array_to_string(hit, '|') AS matches FROM hits",
)
def remainders(spark: SparkSession, sf: str) -> DataFrame:
    failed = ev.failed_rows(
        ev.join_divergences(fx.exec_rows(spark, sf, dealt=True), fx.divergence_rows(spark, sf))
    )
    return cl.with_features(failed).select(
        "index", "remainder", F.array_join("matches", "|").alias("matches")
    )


_QUESTION = "'Orders of customer ' || CAST(cust AS STRING) || '?'"
_STRICT = f"CASE WHEN index % 9 = 0 THEN prompt ELSE {_QUESTION} END"


@query(
    "forget_items",
    f"""WITH {_CLASSED}, e AS (SELECT *, unnest([CASE WHEN c1 THEN 1 END, CASE WHEN c2 THEN 2 END, CASE WHEN c3 THEN 3 END]) AS c FROM classed)
        SELECT CAST(index AS STRING) AS id, {_STRICT} AS question, predict AS answer, db_id, 'predict' AS answer_source,
          FALSE AS original_exec_match, tail AS forget_tail, 'First' AS forget_mode, split_part(tail, ' ', 1) AS forget_part,
          CAST(c AS INT) AS error_class FROM e WHERE c IS NOT NULL""",
)
def items(spark: SparkSession, sf: str) -> DataFrame:
    return it.forget_items(_classified(spark, sf))


_CHARACTER_ITEMS = f"""{o.PAIRS},
f AS (SELECT * FROM sql_pairs WHERE NOT exec_match),
z AS (SELECT *, CASE WHEN predict = label THEN -1 ELSE coalesce(list_position(list_transform(
    range(greatest(length(predict), length(label))),
    lambda i: predict[i+1] IS DISTINCT FROM label[i+1]), true), 0) - 1 END AS cut FROM f),
t AS (SELECT *, CASE WHEN cut = -1 THEN predict ELSE substr(predict, cut + 1) END AS tail FROM z),
character_items AS (
  SELECT CAST(index AS STRING) AS id, {_STRICT} AS question, predict AS answer, db_id, 'predict' AS answer_source,
    exec_match AS original_exec_match, error AS original_error, tail AS forget_tail, m.mode AS forget_mode,
    CASE m.mode WHEN 'Whole' THEN tail ELSE split_part(trim(tail), ' ', 1) END AS forget_part
  FROM t, (VALUES ('First'), ('Whole')) m(mode))"""


@query("character_items", f"WITH {_CHARACTER_ITEMS} SELECT * FROM character_items")
def character_items(spark: SparkSession, sf: str) -> DataFrame:
    return it.character_items(fx.exec_rows(spark, sf))


@query(
    "training_defaults",
    """SELECT o_orderkey AS index, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS STRING) ELSE 'item' || CAST(o_custkey AS STRING) END AS id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'Whole' ELSE 'First' END AS forget_mode FROM orders""",
)
def defaults(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = fx.table(spark, sf, "orders").select(
        key.alias("index"),
        F.when(key % 4 != 0, F.concat(F.lit("item"), F.col("o_custkey").cast("string"))).alias("id"),
        F.when(key % 3 == 0, F.lit("Whole")).alias("forget_mode"),
    )
    return it.training_defaults(rows)


@query(
    "cosine_pairs",
    """SELECT a.vec_id AS a, b.vec_id AS b,
         round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
           / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
              * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS similarity
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    pairs = vectors.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return cosine_pairs(pairs, vectors).withColumn("similarity", F.round("similarity", 6))


@query(
    "surplus_rows",
    f"""WITH r AS ({fx.plain(fx.RESULT_ROWS)}),
        s AS (SELECT index, line_no, quantity, flag, sum(CASE WHEN side = 'pred' THEN 1 ELSE -1 END) AS n FROM r GROUP BY ALL)
        SELECT index, CASE WHEN n > 0 THEN 'pred' ELSE 'gold' END AS side, count(*) AS n_kinds, CAST(sum(abs(n)) AS BIGINT) AS n_rows
        FROM s WHERE n <> 0 GROUP BY 1, 2""",
)
def surplus(spark: SparkSession, sf: str) -> DataFrame:
    """What either side of a mismatch has more of, summed up per index."""
    rows = ev.surplus_rows(fx.result_rows(spark, sf))
    return rows.groupBy("index", "side").agg(F.count("*").alias("n_kinds"), F.sum("n_rows").alias("n_rows"))
