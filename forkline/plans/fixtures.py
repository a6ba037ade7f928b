"""Tables of the data model derived from the given parquet tables.

The SQL here runs unchanged on Spark and, with the braces removed, on the engine that
checks the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.operators.diverge import diverge
from forkline.operators.normalize import normalize_pairs
from forkline.schemas import STEP_TYPE

# Each order is one pair: gold varies by customer, the kind of error by order key.
SQL_PAIRS = """
SELECT o_orderkey AS index, o_custkey AS cust, o_orderkey % 8 AS kind,
  'db_' || CAST(o_custkey % 20 AS STRING) AS db_id,
  '<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) ||
  'Orders of customer ' || CAST(o_custkey AS STRING) || '? ' ||
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) END
  AS prompt,
  'SELECT T1.o_orderstatus FROM orders AS T1 WHERE T1.o_custkey = ' || CAST(o_custkey AS STRING) AS label,
  CASE o_orderkey % 8
    WHEN 1 THEN 'SELECT x.o_orderstatus FROM orders x WHERE x.o_custkey = ' || CAST(o_custkey AS STRING)
    WHEN 2 THEN 'SELECT T1.o_totalprice FROM orders AS T1 WHERE T1.o_custkey = ' || CAST(o_custkey AS STRING)
    WHEN 3 THEN 'SELECT T1.o_orderstatus FROM orders AS T1'
    WHEN 4 THEN 'SELECT T1.o_orderstatus FROM orders AS T1 WHERE T1.o_custkey = ' || CAST(o_custkey AS STRING) || ' ORDER BY T1.o_totalprice'
    WHEN 5 THEN 'SELECT T1.o_orderstatus FROM orders AS T1 WHERE T1.o_custkey = ' || CAST(o_custkey + 1 AS STRING)
    WHEN 6 THEN 'select  T1.o_orderstatus from orders AS T1 where T1.o_custkey = ' || CAST(o_custkey AS STRING)
    WHEN 7 THEN 'SELECT T1.o_orderstatus FROM orders AS T1 GROUP BY T1.o_orderstatus'
    ELSE 'SELECT T1.o_orderstatus FROM orders AS T1 WHERE T1.o_custkey = ' || CAST(o_custkey AS STRING)
  END AS predict,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 8 IN (0,1,6) END AS exec_match,
  CASE WHEN o_orderkey % 8 IN (0,1,6) THEN NULL ELSE 'results differ' END AS error
FROM {orders}
"""

# Pairs put together from clause parts that vary by key: joins, two conjuncts in either
# order, HAVING, LIMIT (also beyond 32 bits), literals with quotes, CAST with an alias, a
# table whose name starts another's, and nested texts, which no side takes apart.
WIDE_PAIRS = """
SELECT *,
  CASE WHEN nested THEN 'SELECT a FROM item WHERE a IN (SELECT b FROM items WHERE c = ' || CAST(index AS STRING) || ')'
    ELSE 'SELECT ' || sel || ' FROM item AS T1' || CASE WHEN join1 = 1 THEN ' JOIN items AS T2 ON T2.k = T1.k' ELSE '' END
      || ' WHERE ' || conj_a || ' AND ' || conj_b || ' GROUP BY T1.a' || hav1 || ' ORDER BY T1.a' || lim1 END AS label,
  CASE WHEN nested AND index % 62 = 0 THEN 'SELECT a  FROM item WHERE a IN (SELECT b FROM items WHERE c = ' || CAST(index AS STRING) || ')'
    WHEN nested THEN 'SELECT a FROM item WHERE a IN (SELECT b FROM items)'
    ELSE 'SELECT ' || sel || ' FROM item AS T1' || CASE WHEN join2 = 1 THEN ' JOIN items AS T2 ON T2.k = T1.k' ELSE '' END
      || ' WHERE ' || CASE WHEN index % 3 = 0 THEN conj_b2 || ' AND ' || conj_a ELSE conj_a || ' AND ' || conj_b2 END
      || ' GROUP BY T1.a' || hav2 || ' ORDER BY T1.a' || lim2 END AS predict
FROM (SELECT o_orderkey AS index, o_orderkey % 31 = 0 AS nested,
  o_custkey % 2 AS join1, CASE WHEN o_orderkey % 5 = 0 THEN 1 - o_custkey % 2 ELSE o_custkey % 2 END AS join2,
  'CAST(T1.n AS INT) AS y, count(*) AS c' AS sel,
  'T1.b = ' || CAST(o_custkey AS STRING) AS conj_a,
  'T1.c = ' || chr(39) || 'it' || chr(39) || chr(39) || 's, AND' || chr(39) AS conj_b,
  'T1.c = ' || chr(39) || 'it' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE chr(39) || chr(39) END || 's, AND' || chr(39) AS conj_b2,
  CASE WHEN o_custkey % 3 = 0 THEN ' HAVING count(*) > ' || CAST(o_custkey % 4 AS STRING) ELSE '' END AS hav1,
  CASE WHEN o_custkey % 3 = 0 THEN ' HAVING count(*) > ' || CAST((o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 4 AS STRING) ELSE '' END AS hav2,
  CASE WHEN o_custkey % 5 < 3 THEN ' LIMIT 1000000000' || CAST(o_custkey % 5 AS STRING) ELSE '' END AS lim1,
  CASE WHEN o_custkey % 5 < 3 AND o_orderkey % 13 > 0 THEN ' LIMIT 1000000000' || CAST(o_custkey % 5 AS STRING) ELSE '' END AS lim2
  FROM {orders}) AS p
"""

# Pairs over three tables, of which one's name begins the others', and aliases of which one
# begins the next; predictions use other aliases, and none for one table.
MULTI_PAIRS = """
SELECT index, a, b, c, d,
  'SELECT ' || a || '.x, ' || b || '.y AS total, ' || c || '.z FROM item AS ' || a || ' JOIN items ' || b || ' ON ' || a || '.k = ' || b
    || '.k LEFT JOIN item_parts AS ' || c || ' ON ' || c || '.k = ' || b || '.k WHERE ' || a || '.n > ' || CAST(index AS STRING) AS label,
  'SELECT ' || d || '.x,  items.y, ' || b || '.z FROM item ' || d || ' JOIN items ON ' || d || '.k = items.k'
    || ' LEFT JOIN item_parts AS ' || b || ' ON ' || b || '.k = items.k WHERE ' || d || '.n > ' || CAST(index AS STRING) AS predict
FROM (SELECT o_orderkey AS index,
  CASE o_orderkey % 3 WHEN 0 THEN 'T1' WHEN 1 THEN 'a' ELSE 'q' END AS a,
  CASE o_orderkey % 3 WHEN 0 THEN 'T2' WHEN 1 THEN 'ab' ELSE 'p' END AS b,
  CASE o_orderkey % 3 WHEN 0 THEN 'T3' WHEN 1 THEN 'abc' ELSE 'i' END AS c,
  CASE WHEN o_custkey % 2 = 0 THEN 'T9' ELSE 'z' END AS d
  FROM {orders}) AS names
"""

# Result rows of both sides; (order, line) repeats, so repeats count.
RESULT_ROWS = """
SELECT l_orderkey AS index, side,
  CAST(l_linenumber AS DOUBLE) AS line_no,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL
       WHEN side = 'pred' AND l_orderkey % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END AS quantity,
  CASE WHEN side = 'pred' AND l_orderkey % 13 = 0 AND l_linenumber = 1 THEN 'X' ELSE l_returnflag END AS flag
FROM (SELECT *, 'pred' AS side FROM {lineitem} UNION ALL SELECT *, 'gold' AS side FROM {lineitem}) AS s
"""

# Documents with a known outcome; where none is labelled the outcome is null.
DOCUMENT_OUTCOMES = """
SELECT d.doc_id AS index, d.text AS prompt, d.text AS predict, d.source AS label,
  CASE WHEN l.quality = 1 THEN TRUE WHEN l.quality = 0 THEN FALSE ELSE NULL END AS exec_match,
  CASE WHEN l.quality = 0 THEN 'low' ELSE NULL END AS error
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

TOKEN_LOSS = """
SELECT CAST(FLOOR(l_orderkey / 4) AS BIGINT) AS batch_id,
  CASE WHEN l_orderkey % 2 = 0 THEN 'forget' ELSE 'retain' END AS side,
  l_orderkey AS sample_id, CAST(l_linenumber - 1 AS BIGINT) AS pos,
  CASE WHEN l_suppkey % 4 = 0 THEN -100 ELSE l_partkey END AS label_id,
  l_linenumber % 2 AS forget_mask, l_discount AS nll, l_tax AS ref_nll
FROM {lineitem}
"""

# A user turn with the assistant turn that answers it.
CHAT_PAIRS = """
SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer
FROM {conversations} q JOIN {conversations} a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run fixture SQL over the tables it names in braces."""
    names = [n for n in ("orders", "lineitem", "documents", "labels", "conversations", "customer", "embeddings") if f"{{{n}}}" in sql]
    return spark.sql(sql, **{n: table(spark, sf, n) for n in names})


#: Pairs whose texts one task works on, where there are more than four such tasks for each core.
PAIRS_IN_TASK = 100_000


def spread(pairs: DataFrame) -> DataFrame:
    """The keys of a small file dealt to all cores, as the work on the texts of a pair by far
    outweighs its bytes."""
    tasks = max(4 * pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // PAIRS_IN_TASK))
    return pairs.repartition(tasks, "o_orderkey")


def wide_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(WIDE_PAIRS, orders=spread(table(spark, sf, "orders")))


def plain(sql: str) -> str:
    """Fixture SQL over tables that are registered by name."""
    return sql.replace("{", "").replace("}", "")


def sql_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(SQL_PAIRS, orders=table(spark, sf, "orders"))


def spread_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(SQL_PAIRS, orders=spread(table(spark, sf, "orders")))


def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    from forkline.functions.values import result_values

    vals = result_values(line_no="number", quantity="number", flag="text")
    return derived(spark, sf, RESULT_ROWS).select("index", "side", vals.alias("vals"))


def run_status(spark: SparkSession, sf: str) -> DataFrame:
    """Which runs failed, and which texts could not be parsed."""
    key = F.col("o_orderkey")

    def when(modulus: int, text: str, name: str):
        return F.when(key % modulus == 0, F.lit(text)).alias(name)

    return table(spark, sf, "orders").select(
        key.alias("index"),
        when(17, "prediction failed", "pred_error"),
        when(23, "gold failed", "gold_error"),
        when(19, "prediction not parsed", "pred_parse_error"),
        when(29, "gold not parsed", "gold_parse_error"),
    )


def divergence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Divergences of the pairs, with the candidates of the divergent step."""
    kind, cust = F.col("kind"), F.col("cust")

    def top(*tokens: str):
        return F.array(*[F.lit(t) for t in tokens])

    far = top("alpha", "beta", "gamma", "delta", "eps")
    short = top("T1.o_totalprice", "T1", "alpha", "beta", "gamma")
    near = top("T1.o_totalprice", "T1.o_orderstatus", "alpha", "beta", "gamma")
    wrong_column = (kind == 2) & (cust % 2 == 0)
    step = F.struct(
        F.lit(1).alias("step"),
        F.when(wrong_column, "T1.o_totalprice").otherwise("alpha").alias("generated_token"),
        F.lit(0).cast("bigint").alias("generated_token_id"),
        F.when(wrong_column & (cust % 4 == 2), short)
        .when(wrong_column, near)
        .otherwise(far)
        .alias("top5_tokens"),
        F.array().cast("array<bigint>").alias("top5_token_ids"),
        F.array().cast("array<double>").alias("top5_probs"),
    ).cast(STEP_TYPE)
    rows = diverge(normalize_pairs(spread_pairs(spark, sf)))
    return rows.withColumn("logits_top5", F.array(step)).drop("db_id", "exec_match", "error")


def exec_rows(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """Outcomes of the pairs; ``dealt``: as :func:`divergence_rows` are, so that the two meet without
    another shuffle."""
    pairs = spread_pairs(spark, sf) if dealt else sql_pairs(spark, sf)
    return pairs.select(
        "index", "prompt", "predict", "label", "exec_match", "error", F.col("label").alias("gold_sql"), "db_id"
    )


def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One vector per token; two tokens share a vector, so their similarity is one."""
    names = F.when(
        F.col("vec_id") == 0, F.array(F.lit("T1.o_totalprice"), F.lit("T1.o_orderstatus"), F.lit("tok_0"))
    ).when(F.col("vec_id") == 1, F.array(F.lit("T1"), F.lit("tok_1")))
    names = F.coalesce(names, F.array(F.concat(F.lit("tok_"), F.col("vec_id").cast("string"))))
    return table(spark, sf, "embeddings").select(
        F.explode(names).alias("token"), F.col("embedding").cast("array<double>").alias("embedding")
    )


def step_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("step_id"),
        F.posexplode("embedding").alias("_pos", "_score"),
    ).select("step_id", F.col("_pos").cast("bigint").alias("token_id"), F.col("_score").cast("double").alias("score"))
