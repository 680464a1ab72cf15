"""Answer cache: lookups, verification, lifetimes, fallbacks, decomposition, fuzzy search and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import cache as C
from larder.operators import fuzzy
from larder.operators import qualify
from larder.plans import fixtures as X
from larder.session import table

from . import query


def _keyed(spark, sf_dir):
    return X.asks(spark, sf_dir).withColumn("key", T.answer_key(F.col("question"), namespace=F.concat(F.lit("n"), F.col("namespace_id"))))


KEYED_SQL = f"""{X.ASKS_SQL}, keyed AS (SELECT *, sha256({X.norm_sql('question')} || '|ns:n' || namespace_id) AS key FROM asks)"""
SERVED_SQL = f"""{KEYED_SQL}, looked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY asked_s, question_id) > 1 AS hit,
  first_value(question_id) OVER (PARTITION BY key ORDER BY asked_s, question_id) AS source_id FROM keyed)"""


@query("cache_exact_lookup", f"""WITH {SERVED_SQL} SELECT namespace_id, count(*) AS asked, count(*) FILTER (WHERE hit) AS hits,
  round(100.0 * count(*) FILTER (WHERE hit) / count(*), 2) AS hit_rate, count(DISTINCT key) AS keys FROM looked GROUP BY namespace_id""")
def cache_exact_lookup(spark, sf_dir):
    looked = C.exact_lookup(_keyed(spark, sf_dir))
    return looked.groupBy("namespace_id").agg(F.count("*").alias("asked"), F.count_if("hit").alias("hits"), F.round(100.0 * F.count_if("hit") / F.count("*"), 2).alias("hit_rate"), F.countDistinct("key").alias("keys"))


@query("cache_exact_sources", f"WITH {SERVED_SQL} SELECT question_id, hit, source_id FROM looked")
def cache_exact_sources(spark, sf_dir):
    return C.exact_lookup(_keyed(spark, sf_dir)).select("question_id", "hit", "source_id")


def _manifests(spark, sf_dir):
    """Cached answers citing two sections each; some hashes are outdated or missing, some sections unknown."""
    docs = table(spark, sf_dir, "documents")
    sections = docs.select(F.col("doc_id").alias("section_id"), F.sha2("text", 256).alias("version_hash"), (F.col("doc_id") % 11 != 0).alias("is_current"), "source", "text")
    d = F.col("section_id")
    own = F.when(d % 7 == 0, F.sha2(F.lit("old"), 256)).when(d % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("version_hash"))
    entry = F.struct(d.alias("section_id"), own.alias("version_hash"))
    missing = F.struct((-d).alias("section_id"), F.lit("x").alias("version_hash"))
    entries = F.when(d % 5 == 0, F.array().cast("array<struct<section_id:bigint,version_hash:string>>")).when(d % 17 == 0, F.array(entry, missing)).otherwise(F.array(entry))
    return sections.select((d + 100_000).alias("cache_id"), entries.alias("source_sections")), sections


MANIFEST_SQL = """sections AS (SELECT doc_id AS section_id, sha256(text) AS version_hash, doc_id % 11 <> 0 AS is_current FROM documents),
entries AS (
  SELECT section_id + 100000 AS cache_id, section_id, CASE WHEN section_id % 7 = 0 THEN sha256('old') WHEN section_id % 13 = 0 THEN NULL ELSE version_hash END AS expected FROM sections WHERE section_id % 5 <> 0
  UNION ALL SELECT section_id + 100000, -section_id, 'x' FROM sections WHERE section_id % 5 <> 0 AND section_id % 17 = 0),
checked AS (SELECT cache_id, bool_and(coalesce(expected = version_hash, false)) AS ok FROM entries e LEFT JOIN (SELECT * FROM sections WHERE is_current) s ON e.section_id = s.section_id GROUP BY cache_id)"""


@query("double_verify", f"WITH {MANIFEST_SQL} SELECT s.section_id + 100000 AS cache_id, coalesce(ok, true) AS verified FROM sections s LEFT JOIN checked c ON c.cache_id = s.section_id + 100000")
def double_verify(spark, sf_dir):
    cache, sections = _manifests(spark, sf_dir)
    return C.verify(cache, sections).select("cache_id", "verified")


@query("bulk_verify", f"WITH {MANIFEST_SQL} SELECT count(*) AS checked, count(*) FILTER (WHERE coalesce(ok, true)) AS valid, count(*) FILTER (WHERE NOT coalesce(ok, true)) AS stale FROM sections s LEFT JOIN checked c ON c.cache_id = s.section_id + 100000")
def bulk_verify(spark, sf_dir):
    cache, sections = _manifests(spark, sf_dir)
    return C.verify(cache, sections).agg(F.count("*").alias("checked"), F.count_if("verified").alias("valid"), F.count_if(~F.col("verified")).alias("stale"))


@query("ttl_expiry", f"WITH {X.CACHE_SQL} SELECT cache_id, CASE WHEN ttl_seconds IS NULL THEN false WHEN cache_id % 31 = 0 THEN true ELSE {X.AS_OF} - created_s > ttl_seconds END AS expired FROM cache")
def ttl_expiry(spark, sf_dir):
    created = F.when(F.col("cache_id") % 31 != 0, F.col("created_s"))
    return X.answer_cache(spark, sf_dir).select("cache_id", C.expired(created, F.col("ttl_seconds"), F.lit(X.AS_OF)).alias("expired"))


@query("temporal_bypass", f"""WITH {MANIFEST_SQL} SELECT s.section_id + 100000 AS cache_id, CASE WHEN s.section_id % 3 = 0 THEN 'skipped' WHEN coalesce(ok, true) THEN 'verified' ELSE 'stale' END AS outcome
  FROM sections s LEFT JOIN checked c ON c.cache_id = s.section_id + 100000""")
def temporal_bypass(spark, sf_dir):
    cache, sections = _manifests(spark, sf_dir)
    filters = F.when((F.col("cache_id") - 100_000) % 3 == 0, F.create_map(F.lit("temporal_scope"), F.lit("2024"))).otherwise(F.create_map(F.lit("temporal_scope"), F.lit("")))
    checked = C.verify(cache, sections).withColumn("scope", filters["temporal_scope"])
    return checked.select("cache_id", F.when(T.present(F.col("scope")), "skipped").when(F.col("verified"), "verified").otherwise("stale").alias("outcome"))


@query("namespace_fallback", f"""WITH {X.CACHE_SQL}, scoped AS (SELECT answer_key, min(cache_id) AS cache_id FROM cache WHERE is_valid AND namespace_id <> 0 GROUP BY answer_key),
  shared AS (SELECT question_normalized, min(cache_id) AS cache_id FROM cache WHERE is_valid AND namespace_id = 0 GROUP BY question_normalized),
  looked AS (SELECT c.cache_id AS question_id, c.namespace_id, c.namespace_id <> 3 AS falls_back, sha256(question_normalized || '|ns:n' || ((namespace_id + c.cache_id % 2) % 4)) AS key, question_normalized FROM cache c)
  SELECT question_id, coalesce(s.cache_id, CASE WHEN falls_back THEN p.cache_id END) AS cache_id,
         CASE WHEN s.cache_id IS NOT NULL THEN 'scoped' WHEN falls_back AND p.cache_id IS NOT NULL THEN 'public' ELSE 'miss' END AS outcome
  FROM looked l LEFT JOIN scoped s ON l.key = s.answer_key LEFT JOIN shared p ON l.question_normalized = p.question_normalized""")
def namespace_fallback(spark, sf_dir):
    cache = X.answer_cache(spark, sf_dir)
    scoped = cache.where("is_valid and namespace_id <> 0").groupBy(F.col("answer_key").alias("key")).agg(F.min("cache_id").alias("scoped_id"))
    shared = cache.where("is_valid and namespace_id = 0").groupBy("question_normalized").agg(F.min("cache_id").alias("public_id"))
    where = F.concat(F.lit("n"), (F.col("namespace_id") + F.col("cache_id") % 2) % 4)
    looked = cache.select(F.col("cache_id").alias("question_id"), (F.col("namespace_id") != 3).alias("falls_back"), T.answer_key(F.col("question"), namespace=where).alias("key"), "question_normalized")
    found = looked.join(scoped, "key", "left").join(shared, "question_normalized", "left")
    public = F.when(F.col("falls_back"), F.col("public_id"))
    return found.select("question_id", F.coalesce("scoped_id", public).alias("cache_id"), F.when(F.col("scoped_id").isNotNull(), "scoped").when(public.isNotNull(), "public").otherwise("miss").alias("outcome"))


@query("cache_upsert", f"""WITH {X.CACHE_SQL}, rows AS (SELECT cache_id, answer_key, answer_text, created_s FROM cache UNION ALL SELECT cache_id + 1000000, answer_key, left('again ' || answer_text, 100000), created_s + 60 FROM cache WHERE cache_id % 2 = 0)
  SELECT cache_id, answer_key, sha256(answer_text) AS answer_hash FROM (SELECT *, row_number() OVER (PARTITION BY answer_key ORDER BY created_s DESC) AS n FROM rows) WHERE n = 1""")
def cache_upsert(spark, sf_dir):
    cache = X.answer_cache(spark, sf_dir).select("cache_id", "answer_key", "answer_text", "created_s")
    new = cache.where("cache_id % 2 = 0").select((F.col("cache_id") + 1_000_000).alias("cache_id"), "answer_key", F.substring(F.concat(F.lit("again "), "answer_text"), 1, 100_000).alias("answer_text"), (F.col("created_s") + 60).alias("created_s"))
    return C.upsert(cache, new, "answer_key", "created_s").select("cache_id", "answer_key", F.sha2("answer_text", 256).alias("answer_hash"))


COMPOSED_SQL = f"""WITH {X.EXCHANGES_SQL}, asked AS (SELECT question_id, question, CASE question_id % 3 WHEN 0 THEN left(question, 30) || ' and ' || right(question, 30) WHEN 1 THEN 'Find ' || left(question, 20) || ' versus ' || right(question, 20) ELSE left(question, 25) || ' vs ' || right(question, 25) END AS q FROM exchanges),
  cut AS (SELECT question_id, trim(regexp_replace(trim(regexp_extract(q, '(?is)^(.+?)\\b(?:compare|compared?\\s+to|differences?\\s+between|vs\\.?|versus|and)\\b(.+)$', 1)), '^,+|,+$', '', 'g')) AS a,
         trim(regexp_replace(trim(regexp_extract(q, '(?is)^(.+?)\\b(?:compare|compared?\\s+to|differences?\\s+between|vs\\.?|versus|and)\\b(.+)$', 2)), '^,+|,+$', '', 'g')) AS b FROM asked)"""


@query("composable_and_split", COMPOSED_SQL + r""" SELECT question_id, a AS part_a, b AS part_b FROM cut WHERE length(a) >= 3 AND length(b) >= 3
  AND lower(string_split_regex(a, '\s+')[1]) NOT IN ('find', 'show', 'list', 'get', 'give', 'tell', 'search')""")
def composable_and_split(spark, sf_dir):
    q, i = F.col("question"), F.col("question_id")
    right = lambda n: F.substring(q, F.greatest(F.length(q) - n + 1, F.lit(1)), F.lit(n))
    asked = F.when(i % 3 == 0, F.concat(F.left(q, F.lit(30)), F.lit(" and "), right(30))).when(i % 3 == 1, F.concat(F.lit("Find "), F.left(q, F.lit(20)), F.lit(" versus "), right(20))).otherwise(F.concat(F.left(q, F.lit(25)), F.lit(" vs "), right(25)))
    cut = X.exchanges(spark, sf_dir).select("question_id", C.split_on_and(asked).alias("p")).where("p is not null")
    return cut.select("question_id", F.col("p")[0].alias("part_a"), F.col("p")[1].alias("part_b"))


#: Asked: a stored question and the next one of its conversation, or something unknown; a third of them under a filter. Stored: every answered question, every second
#: one under its filter.
PARTS = r"(?is)^(.+?)\b(?:compare|compared?\s+to|differences?\s+between|vs\.?|versus|and)\b(.+)$"
COMPOSABLE_SQL = rf"""{X.EXCHANGES_SQL}, asked AS (
    SELECT question_id, CASE WHEN conv_id % 3 = 0 THEN 'lane:' || (conv_id % 2 + 1) ELSE '' END AS scope, question || ' and ' || coalesce(lead(question) OVER (PARTITION BY conv_id ORDER BY turn), 'something unknown') AS q FROM exchanges),
  cut AS (SELECT question_id, scope, trim(regexp_replace(trim(regexp_extract(q, '{PARTS}', 1)), '^,+|,+$', '', 'g')) AS a, trim(regexp_replace(trim(regexp_extract(q, '{PARTS}', 2)), '^,+|,+$', '', 'g')) AS b FROM asked),
  subs AS (SELECT question_id, scope, unnest([0, 1]) AS position, unnest([a, b]) AS sub_question FROM cut WHERE length(a) >= 3 AND length(b) >= 3 AND lower(string_split_regex(a, '\s+')[1]) NOT IN ('find', 'show', 'list', 'get', 'give', 'tell', 'search')),
  cache AS (SELECT key, min(question_id) AS cache_id FROM (SELECT question_id, sha256({X.norm_sql('question')} || CASE WHEN question_id % 2 = 0 THEN '|lane:' || (conv_id % 2 + 1) ELSE '' END) AS key FROM exchanges WHERE answer IS NOT NULL) GROUP BY key),
  looked AS (SELECT question_id, position, sub_question, o.cache_id AS own, p.cache_id AS any_id FROM (SELECT *, {X.norm_sql('sub_question')} AS norm FROM subs) s
    LEFT JOIN cache o ON o.key = sha256(norm || CASE WHEN scope = '' THEN '' ELSE '|' || scope END) LEFT JOIN cache p ON p.key = sha256(norm))"""


def _composable(spark, sf_dir):
    rows = X.exchanges(spark, sf_dir)
    lane = F.create_map(F.lit("lane"), (F.col("conv_id") % 2 + 1).cast("string"))
    none = F.create_map().cast("map<string,string>")
    following = F.lead("question").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = rows.select("question_id", F.concat("question", F.lit(" and "), F.coalesce(following, F.lit("something unknown"))).alias("question"), F.when(F.col("conv_id") % 3 == 0, lane).otherwise(none).alias("filters"))
    stored = rows.where("answer is not null").select(F.col("question_id").alias("cache_id"), T.scoped_key(F.col("question"), F.when(F.col("question_id") % 2 == 0, lane).otherwise(none)).alias("key"))
    return C.composable_lookup(asked, stored)


@query("composable_lookup", f"WITH {COMPOSABLE_SQL} SELECT question_id, CAST(position AS BIGINT) AS position, sha256(sub_question) AS sub_hash, coalesce(own, any_id) AS cache_id, own IS NOT NULL AS scoped FROM looked")
def composable_lookup(spark, sf_dir):
    """Sub-questions against the cache, under their filters and then without."""
    return _composable(spark, sf_dir).select("question_id", "position", F.sha2("sub_question", 256).alias("sub_hash"), "cache_id", "scoped")


@query("composable_outcome", f"""WITH {COMPOSABLE_SQL}, sums AS (SELECT question_id, count(*) AS parts, count(coalesce(own, any_id)) AS hits FROM looked GROUP BY question_id)
  SELECT question_id, parts, hits, CASE WHEN hits = parts THEN 'complete' WHEN hits > 0 THEN 'partial' ELSE 'miss' END AS outcome FROM sums""")
def composable_outcome(spark, sf_dir):
    return C.composed(_composable(spark, sf_dir))


@query("fuzzy_topk")
def fuzzy_topk(spark, sf_dir):
    """Each hundredth answered question, misspelt in a word, against all. By code points; SQL's edit distance counts bytes, so a test has a plain version."""
    cache = X.answer_cache(spark, sf_dir)
    misspelt = F.concat(F.left("question", F.length("question") - 2), F.lit("x"), F.substring(F.col("question"), F.length("question") - 1, F.lit(2)))
    return fuzzy.matches(cache.where("cache_id % 100 = 0").select(F.col("cache_id").alias("question_id"), misspelt.alias("question")), cache)


@query("edit_join", r"""WITH told AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM conversations)
  SELECT a.id AS left_id, b.id AS right_id, levenshtein(a.text, b.text) AS edits FROM (SELECT id, left(text, 3) || 'zz' || substr(text, 6) AS text FROM told) a JOIN told b ON abs(length(a.text) - length(b.text)) <= 3 AND levenshtein(a.text, b.text) <= 3""")
def edit_join(spark, sf_dir):
    """Each turn misspelt by two letters, against all turns, within three edits; in ASCII, as SQL's edit distance counts bytes."""
    told = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.regexp_replace("text", "[^ -~]", "?").alias("text"))
    misspelt = F.concat(F.left("text", F.lit(3)), F.lit("zz"), F.substring("text", 6, 1 << 30))
    return fuzzy.within_edits(told.select(F.col("id").alias("left_id"), misspelt.alias("text")), told.select(F.col("id").alias("right_id"), "text"), 3).withColumn("edits", F.col("edits").cast("long"))


STATS_SQL = """count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE NOT is_valid) AS invalidated, CAST(sum(serve_count) AS BIGINT) AS total_serves,
  round(least(100.0, 100.0 * sum(serve_count) / greatest(sum(serve_count) + count(*) FILTER (WHERE serve_count = 0), 1)), 1) AS hit_rate,
  round(sum(CASE WHEN is_valid THEN generation_ms * serve_count ELSE 0.0 END), 2) AS saved_ms, round(avg(generation_ms), 1) AS avg_generation_ms"""


@query("cache_stats", f"WITH {X.CACHE_SQL} SELECT {STATS_SQL} FROM cache")
def cache_stats(spark, sf_dir):
    return C.stats(X.answer_cache(spark, sf_dir))


@query("namespace_stats", f"WITH {X.CACHE_SQL} SELECT namespace_id, {STATS_SQL} FROM cache GROUP BY namespace_id")
def namespace_stats(spark, sf_dir):
    return C.stats(X.answer_cache(spark, sf_dir), ["namespace_id"])


@query("model_comparison", f"""WITH {X.CACHE_SQL} SELECT cache_id, model, serve_count, round(generation_ms * (1 + serve_count), 2) AS ms_without, round(generation_ms + 0.5 * serve_count, 2) AS ms_with,
  round(generation_ms * serve_count - 0.5 * serve_count, 2) AS ms_saved, greatest(1, CAST(floor(length(answer_text) / 4.0) AS BIGINT)) AS tokens FROM cache WHERE is_valid AND serve_count > 0 ORDER BY serve_count DESC, cache_id LIMIT 50""")
def model_comparison(spark, sf_dir):
    """A top-50 report."""
    g, n = F.col("generation_ms"), F.col("serve_count")
    rows = X.answer_cache(spark, sf_dir).where("is_valid and serve_count > 0").orderBy(F.desc("serve_count"), "cache_id").limit(50)
    return rows.select("cache_id", "model", "serve_count", F.round(g * (1 + n), 2).alias("ms_without"), F.round(g + 0.5 * n, 2).alias("ms_with"), F.round(g * n - 0.5 * n, 2).alias("ms_saved"), T.quarter_tokens(F.col("answer_text")).alias("tokens"))


@query("comparison_rollup", f"""WITH {X.CACHE_SQL} SELECT model, count(*) AS entries, CAST(sum(serve_count) AS BIGINT) AS serves, round(sum(generation_ms * (1 + serve_count)), 2) AS ms_without, round(sum(generation_ms + 0.5 * serve_count), 2) AS ms_with,
  round(sum(generation_ms * (1 + serve_count)) / sum(generation_ms + 0.5 * serve_count), 1) AS savings_factor, CAST(sum(tokens) AS BIGINT) AS tokens_with, CAST(sum(tokens * (1 + serve_count)) AS BIGINT) AS tokens_without,
  round(sum(cost), 4) AS cost_with, round(sum(cost * (1 + serve_count)), 4) AS cost_without
  FROM (SELECT c.*, greatest(1, CAST(floor(length(answer_text) / 4.0) AS BIGINT)) AS tokens, floor((CAST(length(question) AS DOUBLE) / 4 * CAST(rate_in AS DOUBLE) + CAST(length(answer_text) AS DOUBLE) / 4 * CAST(rate_out AS DOUBLE)) / 1000 * 1e6 + 0.5) / 1e6 AS cost FROM (
    SELECT *, CASE WHEN model LIKE 'gpt-4o%' THEN 0.0025 WHEN model LIKE 'gpt-4-turbo%' THEN 0.01 WHEN model LIKE 'claude-3-haiku%' THEN 0.00025 ELSE 0.0 END AS rate_in,
           CASE WHEN model LIKE 'gpt-4o%' THEN 0.01 WHEN model LIKE 'gpt-4-turbo%' THEN 0.03 WHEN model LIKE 'claude-3-haiku%' THEN 0.00125 ELSE 0.0 END AS rate_out FROM cache WHERE is_valid AND serve_count > 0) c) GROUP BY ROLLUP (model)""")
def comparison_rollup(spark, sf_dir):
    """With the cache and without it, by model and in all (a null model): time, tokens and costs."""
    served = 1 + F.col("serve_count")
    without, with_cache = F.sum(F.col("generation_ms") * served), F.sum(F.col("generation_ms") + 0.5 * F.col("serve_count"))
    rows = X.answer_cache(spark, sf_dir).where("is_valid and serve_count > 0").withColumns({"tokens": T.quarter_tokens(F.col("answer_text")), "cost": T.generation_cost(F.col("model"), F.col("answer_text"), F.col("question"))})
    return rows.rollup("model").agg(
        F.count("*").alias("entries"), F.sum("serve_count").alias("serves"), F.round(without, 2).alias("ms_without"), F.round(with_cache, 2).alias("ms_with"), F.round(without / with_cache, 1).alias("savings_factor"),
        F.sum("tokens").alias("tokens_with"), F.sum(F.col("tokens") * served).alias("tokens_without"), F.round(F.sum("cost"), 4).alias("cost_with"), F.round(F.sum(F.col("cost") * served), 4).alias("cost_without"),
    )


@query("recent_queries", f"WITH {X.CACHE_SQL} SELECT cache_id, namespace_id, created_s, serve_count FROM cache ORDER BY created_s DESC, cache_id LIMIT 20 OFFSET 5")
def recent_queries(spark, sf_dir):
    """A page of a report: the newest entries."""
    return X.answer_cache(spark, sf_dir).orderBy(F.desc("created_s"), "cache_id").offset(5).limit(20).select("cache_id", "namespace_id", "created_s", "serve_count")


@query("cache_qualified_hits", f"""WITH {SERVED_SQL}, gated AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY asked_s, question_id) > 1 AS has_history FROM looked)
  SELECT namespace_id, hit, (has_history AND len(list_filter(string_split_regex(trim(question), '\\s+'), lambda x: x <> '')) <= 3) AS refused, count(*) AS n FROM gated GROUP BY ALL""")
def cache_qualified_hits(spark, sf_dir):
    earlier = F.row_number().over(Window.partitionBy("conv_id").orderBy("asked_s", "question_id")) > 1
    looked = C.exact_lookup(_keyed(spark, sf_dir)).withColumn("refused", earlier & (qualify.word_count(F.col("question")) <= 3))
    return looked.groupBy("namespace_id", "hit", "refused").agg(F.count("*").alias("n"))


@query("increment_serves", f"""WITH {SERVED_SQL}, hits AS (SELECT source_id, count(*) AS n FROM looked WHERE hit GROUP BY source_id), records AS (SELECT question_id AS cache_id, question_id % 7 AS serve_count FROM exchanges WHERE answer IS NOT NULL)
  SELECT cache_id, serve_count + coalesce(n, 0) AS serve_count FROM records LEFT JOIN hits ON cache_id = source_id""")
def increment_serves(spark, sf_dir):
    hits = C.exact_lookup(_keyed(spark, sf_dir)).where("hit").groupBy(F.col("source_id").alias("cache_id")).agg(F.count("*").alias("n"))
    return X.answer_cache(spark, sf_dir).join(hits, "cache_id", "left").select("cache_id", (F.col("serve_count") + F.coalesce("n", F.lit(0))).alias("serve_count"))
