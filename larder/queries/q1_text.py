"""Text core: normalisation, keys, similarity measures, curves, estimates and the context gate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import qualify
from larder.plans import fixtures as X
from larder.session import table

from . import query


@query("normalize_query", f"SELECT conv_id, turn, {X.norm_sql('text')} AS normalized FROM conversations")
def normalize_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize(F.col("text")).alias("normalized"))


@query("normalize_fuzzy", f"SELECT conv_id, turn, coalesce(array_to_string(list_sort({X.tokens_sql('text')}), ' '), '') AS normalized FROM conversations")
def normalize_fuzzy(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_fuzzy(F.col("text")).alias("normalized"))


@query(
    "answer_key",
    f"""SELECT doc_id, sha256({X.norm_sql('text')} || '|lane:' || (doc_id % 3 + 1) || CASE WHEN source = '' THEN '' ELSE '|source:' || source END
        || CASE WHEN lang <> 'en' THEN '|lang:' || lang ELSE '' END || '|ns:n' || (doc_id % 4)) AS answer_key FROM documents""",
)
def answer_key(spark, sf_dir):
    filters = {"source": F.col("source"), "lane": F.col("doc_id") % 3 + 1, "empty": F.lit("")}
    return table(spark, sf_dir, "documents").select("doc_id", T.answer_key(F.col("text"), filters, language=F.col("lang"), namespace=F.concat(F.lit("n"), F.col("doc_id") % 4)).alias("answer_key"))


PAIRS_SQL = f"""WITH {X.EXCHANGES_SQL}, pairs AS (
  SELECT question_id, {X.norm_sql('question')} AS a, {X.norm_sql('answer')} AS b FROM exchanges WHERE answer IS NOT NULL), sets AS (
  SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS s, list_distinct(list_filter(string_split(b, ' '), lambda x: x <> '')) AS t FROM pairs), sized AS (
  SELECT *, len(list_intersect(s, t)) AS shared, len(list_distinct(list_concat(s, t))) AS either, least(len(s), len(t)) AS least_size FROM sets)"""
JACCARD_SQL = "CASE WHEN either = 0 THEN 0.0 ELSE CAST(shared AS DOUBLE) / either END"
OVERLAP_SQL = "CASE WHEN least_size = 0 THEN 0.0 ELSE CAST(shared AS DOUBLE) / least_size END"


def _pairs(spark, sf_dir):
    rows = X.exchanges(spark, sf_dir).where("answer is not null")
    return rows.select("question_id", T.normalize(F.col("question")).alias("a"), T.normalize(F.col("answer")).alias("b"))


@query("token_sets", f"{PAIRS_SQL} SELECT question_id, round({JACCARD_SQL}, 6) AS jaccard, round({OVERLAP_SQL}, 6) AS overlap FROM sized")
def token_sets(spark, sf_dir):
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    a, b = words(F.col("a")), words(F.col("b"))
    return _pairs(spark, sf_dir).select("question_id", F.round(T.jaccard(a, b), 6).alias("jaccard"), F.round(T.overlap(a, b), 6).alias("overlap"))


@query("levenshtein_similarity")
def levenshtein_similarity(spark, sf_dir):
    """By code points; SQL's function counts bytes, so a test has a plain version."""
    return _pairs(spark, sf_dir).select("question_id", F.round(T.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("fuzzy_similarity")
def fuzzy_similarity(spark, sf_dir):
    """By code points; SQL's edit distance counts bytes, so a test has a plain version."""
    return _pairs(spark, sf_dir).select("question_id", F.round(T.fuzzy_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


CURVE_SQL = """CASE WHEN s >= 0.98 THEN 0.99 WHEN s >= 0.92 THEN 0.85 + (s - 0.92) * 1.5 WHEN s >= 0.85 THEN 0.55 + (s - 0.85) * 4.3
               WHEN s >= 0.75 THEN 0.25 + (s - 0.75) * 3.0 ELSE 0.0 END"""
FUZZY_SQL = "CASE WHEN s >= 0.95 THEN 0.80 WHEN s >= 0.90 THEN 0.50 + (s - 0.90) * 4.0 WHEN s >= 0.85 THEN 0.30 + (s - 0.85) * 4.0 ELSE 0.15 END"


@query("confidence_curves", f"SELECT event_id, round({CURVE_SQL}, 6) AS semantic, round({FUZZY_SQL}, 6) AS fuzzy FROM (SELECT event_id, CAST(event_id % 1001 AS DOUBLE) / 1000 AS s FROM events)")
def confidence_curves(spark, sf_dir):
    s = (F.col("event_id") % 1001).cast("double") / 1000
    return table(spark, sf_dir, "events").select("event_id", F.round(T.semantic_confidence(s), 6).alias("semantic"), F.round(T.fuzzy_confidence(s), 6).alias("fuzzy"))


@query("token_estimates", r"""SELECT doc_id, greatest(1, CAST(floor(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 1.3) AS BIGINT)) AS block_tokens,
       greatest(1, CAST(floor(length(text) / 4.0) AS BIGINT)) AS quarter_tokens FROM documents""")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.block_tokens(F.col("text")).alias("block_tokens"), T.quarter_tokens(F.col("text")).alias("quarter_tokens"))


@query("generation_cost", f"""WITH {X.CACHE_SQL} SELECT cache_id, floor((CAST(length(question) AS DOUBLE) / 4 * CAST(rate_in AS DOUBLE) + CAST(length(answer_text) AS DOUBLE) / 4 * CAST(rate_out AS DOUBLE)) / 1000 * 1e6 + 0.5) / 1e6 AS cost FROM (
  SELECT *, CASE WHEN model LIKE 'gpt-4o%' THEN 0.0025 WHEN model LIKE 'gpt-4-turbo%' THEN 0.01 WHEN model LIKE 'claude-3-haiku%' THEN 0.00025 ELSE 0.0 END AS rate_in,
         CASE WHEN model LIKE 'gpt-4o%' THEN 0.01 WHEN model LIKE 'gpt-4-turbo%' THEN 0.03 WHEN model LIKE 'claude-3-haiku%' THEN 0.00125 ELSE 0.0 END AS rate_out FROM cache)""")
def generation_cost(spark, sf_dir):
    return X.answer_cache(spark, sf_dir).select("cache_id", T.generation_cost(F.col("model"), F.col("answer_text"), F.col("question")).alias("cost"))


GATE_SQL = qualify.CONTEXT_PHRASES.replace("'", "''")


@query("context_gate", rf"""WITH asked AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 2 THEN 'Is it ' || text ELSE 'Tell me more about ' || text END AS question,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS has_history FROM conversations)
  SELECT conv_id, turn, NOT ((has_history AND len(list_filter(string_split_regex(trim(question), '\s+'), lambda x: x <> '')) <= 3)
         OR regexp_matches(question, '(?i){GATE_SQL}') OR regexp_matches(trim(question), '(?i){qualify.SHORT_PRONOUN}')) AS serve FROM asked""")
def context_gate(spark, sf_dir):
    earlier = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) > 1
    question = F.when(F.col("turn") % 4 == 0, F.col("text")).when(F.col("turn") % 4 == 2, F.concat(F.lit("Is it "), "text")).otherwise(F.concat(F.lit("Tell me more about "), "text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", question.alias("question"), earlier.alias("has_history"))
    return rows.select("conv_id", "turn", qualify.qualification(F.col("question"), F.col("has_history"))["serve"].alias("serve"))
