"""The engine's entities as derived from plain tables: exchanges, questions, cached answers, usage and sections.

Each has a DataFrame form and, for the oracles, the same rows as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.session import table

#: 2024-01-31 00:00:00 UTC and 2024-01-01, in seconds. Results never depend on the clock.
AS_OF, EPOCH = 1_706_659_200, 1_704_067_200
MODELS = ["gpt-4o-mini-2024", "gpt-4-turbo", "claude-3-haiku", "llama3.2:1b", "unknown-model"]

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def tokens_sql(column: str) -> str:
    return rf"list_filter(string_split_regex(trim(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda x: x <> '' AND x NOT IN ({STOP_SQL}))"


def norm_sql(column: str) -> str:
    return f"coalesce(array_to_string({tokens_sql(column)}, ' '), '')"


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and the assistant turn that follows, if one does."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("*", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("next_text"))
    return turns.where("role = 'user'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"),
        "conv_id",
        "turn",
        F.col("text").alias("question"),
        F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"),
        (F.col("conv_id") % 4).alias("namespace_id"),
        (F.lit(EPOCH) + (F.col("conv_id") * 10 + F.col("turn")) * 60).alias("created_s"),
    )


EXCHANGES_SQL = f"""exchanges AS (
  SELECT conv_id * 100 + turn AS question_id, conv_id, turn, text AS question,
         CASE WHEN next_role = 'assistant' THEN next_text END AS answer, conv_id % 4 AS namespace_id,
         {EPOCH} + (conv_id * 10 + turn) * 60 AS created_s
  FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations)
  WHERE role = 'user')"""


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of questions: every exchange, and for a part of them a later repeat with other spacing, stop words and punctuation."""
    first = exchanges(spark, sf_dir).withColumnRenamed("created_s", "asked_s")
    again = first.where("conv_id % 3 = 0").select(
        (F.col("question_id") + 50).alias("question_id"),
        "conv_id",
        "turn",
        F.concat(F.lit("The "), F.replace("question", F.lit(" "), F.lit("  ")), F.lit(" ?!")).alias("question"),
        "answer",
        F.when(F.col("conv_id") % 5 == 0, (F.col("namespace_id") + 1) % 4).otherwise(F.col("namespace_id")).alias("namespace_id"),
        (F.col("asked_s") + 86_400).alias("asked_s"),
    )
    return first.unionByName(again)


ASKS_SQL = f"""{EXCHANGES_SQL}, asks AS (
  SELECT question_id, conv_id, turn, question, answer, namespace_id, created_s AS asked_s FROM exchanges
  UNION ALL
  SELECT question_id + 50, conv_id, turn, 'The ' || replace(question, ' ', '  ') || ' ?!', answer,
         CASE WHEN conv_id % 5 = 0 THEN (namespace_id + 1) % 4 ELSE namespace_id END, created_s + 86400
  FROM exchanges WHERE conv_id % 3 = 0)"""


def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached answers with serve counts, times, lifetimes and models that follow from their ids."""
    q = F.col("question_id")
    rows = exchanges(spark, sf_dir).where("answer is not null")
    return rows.select(
        q.alias("cache_id"),
        "namespace_id",
        "question",
        T.normalize(F.col("question")).alias("question_normalized"),
        T.answer_key(F.col("question"), namespace=F.concat(F.lit("n"), F.col("namespace_id"))).alias("answer_key"),
        F.col("answer").alias("answer_text"),
        (q % 7).alias("serve_count"),
        (F.length("answer") + 500).cast("double").alias("generation_ms"),
        "created_s",
        F.when(q % 7 > 0, F.col("created_s") + 3600 * (q % 50)).alias("last_served_s"),
        F.when(q % 4 == 1, 3600).when(q % 4 == 2, 86_400).when(q % 4 == 3, 2_592_000).cast("long").alias("ttl_seconds"),
        (q % 9 != 0).alias("is_valid"),
        F.get(F.array(*map(F.lit, MODELS)), (q % 5).cast("int")).alias("model"),
    )


CACHE_SQL = f"""{EXCHANGES_SQL}, cache AS (
  SELECT question_id AS cache_id, namespace_id, question, {norm_sql('question')} AS question_normalized,
         sha256({norm_sql('question')} || '|ns:n' || namespace_id) AS answer_key, answer AS answer_text,
         question_id % 7 AS serve_count, CAST(length(answer) + 500 AS DOUBLE) AS generation_ms, created_s,
         CASE WHEN question_id % 7 > 0 THEN created_s + 3600 * (question_id % 50) END AS last_served_s,
         CASE question_id % 4 WHEN 1 THEN 3600 WHEN 2 THEN 86400 WHEN 3 THEN 2592000 END AS ttl_seconds,
         question_id % 9 <> 0 AS is_valid,
         CASE question_id % 5 WHEN 0 THEN '{MODELS[0]}' WHEN 1 THEN '{MODELS[1]}' WHEN 2 THEN '{MODELS[2]}' WHEN 3 THEN '{MODELS[3]}' ELSE '{MODELS[4]}' END AS model
  FROM exchanges WHERE answer IS NOT NULL)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records from events: views and clicks are served from the cache."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("tenant_id"),
        F.col("event_type").alias("layer"),
        F.get(F.array(*map(F.lit, MODELS)), (e % 5).cast("int")).alias("model"),
        F.col("event_type").isin("view", "click").alias("cached"),
        (e % 900 + 100).alias("input_tokens"),
        (e % 400 + 50).alias("output_tokens"),
        F.col("value").alias("latency_ms"),
    )


USAGE_SQL = f"""usage AS (
  SELECT event_id, ts, user_id AS tenant_id, event_type AS layer,
         CASE event_id % 5 WHEN 0 THEN '{MODELS[0]}' WHEN 1 THEN '{MODELS[1]}' WHEN 2 THEN '{MODELS[2]}' WHEN 3 THEN '{MODELS[3]}' ELSE '{MODELS[4]}' END AS model,
         event_type IN ('view', 'click') AS cached, event_id % 900 + 100 AS input_tokens, event_id % 400 + 50 AS output_tokens, value AS latency_ms
  FROM events)"""
