"""Maintenance: eviction, clean-up, invalidation and re-ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.functions import vectors as V
from larder.operators import cache as C
from larder.operators import facts as stores
from larder.operators import ingest as I
from larder.operators import memory as M
from larder.operators import rules as R
from larder.operators.ranking import keep_most_valuable
from larder.plans import fixtures as X
from larder.session import table

from . import query

HITS_SQL = f"""CASE WHEN last_served_s IS NULL THEN 0.1 ELSE serve_count / greatest(({X.AS_OF} - created_s) / 3600.0, 1.0) * pow(2.0, -greatest(({X.AS_OF} - last_served_s) / 3600.0, 0.001) / 24.0) * 24 END"""


def _hits():
    return C.predicted_hits(F.col("serve_count"), F.col("created_s"), F.col("last_served_s"), F.lit(X.AS_OF))


@query("predict_hits", f"WITH {X.CACHE_SQL} SELECT cache_id, round(CAST({HITS_SQL} AS DOUBLE), 6) AS predicted_hits FROM cache")
def predict_hits(spark, sf_dir):
    return X.answer_cache(spark, sf_dir).select("cache_id", F.round(_hits(), 6).alias("predicted_hits"))


@query("evict_lru", f"""WITH {X.CACHE_SQL}, valued AS (SELECT cache_id, last_served_s, created_s, round(CAST({HITS_SQL} AS DOUBLE) * 0.001 * length(answer_text), 6) AS value FROM cache WHERE is_valid)
  SELECT cache_id FROM (SELECT *, row_number() OVER (ORDER BY value, last_served_s NULLS FIRST, created_s, cache_id) AS n FROM valued) WHERE n > (SELECT greatest(count(*) - 100, 0) FROM valued)""")
def evict_lru(spark, sf_dir):
    """The entries that stay: the 100 of most predicted value."""
    valued = X.answer_cache(spark, sf_dir).where("is_valid").withColumn("value", F.round(_hits() * 0.001 * F.length("answer_text"), 6))
    return keep_most_valuable(valued, 100, F.desc("value"), F.desc_nulls_last("last_served_s"), F.desc("created_s"), F.desc("cache_id")).select("cache_id")


@query("evict_facts", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id % 13, ts, event_id) AS n FROM events) WHERE n > (SELECT greatest(count(*) - 500, 0) FROM events)")
def evict_facts(spark, sf_dir):
    """By ranges, as a store beyond a top-k's reach."""
    facts = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 13).alias("serve_count"), "ts")
    return keep_most_valuable(facts, 500, F.desc("serve_count"), F.desc("ts"), F.desc("event_id"), top=100).select("event_id")


@query("evict_links", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY user_id % 5, ts, event_id) AS n FROM events) WHERE n > (SELECT greatest(count(*) - 1000, 0) FROM events)")
def evict_links(spark, sf_dir):
    links = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("strength"), "ts")
    return keep_most_valuable(links, 1000, F.desc("strength"), F.desc("ts"), F.desc("event_id"), top=100).select("event_id")


@query("cleanup_expired", f"WITH {X.CACHE_SQL} SELECT cache_id FROM cache WHERE ttl_seconds IS NULL OR {X.AS_OF} - created_s <= ttl_seconds")
def cleanup_expired(spark, sf_dir):
    return X.answer_cache(spark, sf_dir).where(~C.expired(F.col("created_s"), F.col("ttl_seconds"), F.lit(X.AS_OF))).select("cache_id")


@query("cleanup_weak_links", "SELECT event_id FROM events WHERE NOT (event_id % 5 = 0 AND ts < TIMESTAMP '2024-01-16 00:00:00')")
def cleanup_weak_links(spark, sf_dir):
    return table(spark, sf_dir, "events").where(~((F.col("event_id") % 5 == 0) & (F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp")))).select("event_id")


@query("cleanup_audit", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-11 00:00:00'")
def cleanup_audit(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-11 00:00:00").cast("timestamp")).select("event_id")


def _answers(spark, sf_dir):
    """Orders as cached answers whose manifests are the parts of their lines."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cache_id")).agg(F.collect_set("l_partkey").alias("sections"))


@query("invalidate_by_section", "SELECT DISTINCT l_orderkey AS cache_id FROM lineitem WHERE l_partkey % 50 = 7")
def invalidate_by_section(spark, sf_dir):
    changed = table(spark, sf_dir, "part").where("p_partkey % 50 = 7").select(F.col("p_partkey").alias("section_id"))
    entries = _answers(spark, sf_dir).select("cache_id", F.explode("sections").alias("section_id"))
    return entries.join(changed, "section_id", "left_semi").select("cache_id").distinct()


@query("cascade_invalidate", """SELECT cache_id, NOT bool_or(hit) AS is_valid FROM (SELECT l_orderkey AS cache_id, l_partkey IN (SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 400 = 3)) AS hit FROM lineitem) GROUP BY cache_id""")
def cascade_invalidate(spark, sf_dir):
    """A change in one section of a document touches answers from all of its current sections."""
    part = table(spark, sf_dir, "part")
    changed = part.where("p_partkey % 400 = 3").select("p_brand").distinct()
    sections = part.join(changed, "p_brand", "left_semi").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("hit"))
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cache_id"), "l_partkey")
    return entries.join(sections, "l_partkey", "left").groupBy("cache_id").agg((~F.bool_or(F.coalesce("hit", F.lit(False)))).alias("is_valid"))


@query("change_events", """SELECT doc_id AS section_id, CASE WHEN doc_id % 10 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM documents WHERE doc_id % 15 <> 0""")
def change_events(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 15 <> 0").select(F.col("doc_id").alias("section_id"), F.sha2("text", 256).alias("old_hash"))
    new = docs.select(F.col("doc_id").alias("section_id"), F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")), 256).alias("new_hash"))
    return old.join(new, "section_id").select("section_id", F.when(F.col("old_hash") != F.col("new_hash"), "updated").otherwise("unchanged").alias("change"))


#: Sections numbered but for every fourth, which is known by its title; some are gone, some new, some changed, some renumbered.
def _reingest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    number, title = F.when(d % 4 != 0, d.cast("string")), F.concat(F.lit("T"), d)
    stored = docs.where(d % 9 != 0).select(F.lit(1).alias("document"), d.alias("section_id"), number.alias("section_number"), title.alias("title"), F.sha2("text", 256).alias("version_hash"))
    body = F.when(d % 10 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    renumbered = F.when(d % 7 == 0, F.concat(F.lit("N"), d)).otherwise(number)
    parsed = docs.where((d % 13 != 0) | (d % 9 == 0)).select(F.lit(1).alias("document"), d.alias("parsed_id"), renumbered.alias("section_number"), title.alias("title"), F.sha2(body, 256).alias("version_hash"))
    return stored, I.matched(stored, parsed)


CHANGES_SQL = """changes AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN doc_id END AS section_id, CASE WHEN doc_id % 13 <> 0 OR doc_id % 9 = 0 THEN doc_id END AS parsed_id,
  CASE WHEN doc_id % 9 = 0 THEN 'new' WHEN doc_id % 13 = 0 THEN 'removed' WHEN doc_id % 10 = 0 THEN 'updated' ELSE 'unchanged' END AS change, sha256(text) AS old_hash, sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' v2' ELSE text END) AS new_hash FROM documents)"""


@query("reingest_diff", f"WITH {CHANGES_SQL} SELECT section_id, parsed_id, change FROM changes")
def reingest_diff(spark, sf_dir):
    """By number, else by title."""
    return _reingest(spark, sf_dir)[1].select("section_id", "parsed_id", "change")


@query("reingest_snapshot", f"""WITH {CHANGES_SQL} SELECT section_id, old_hash AS version_hash, change = 'unchanged' AS is_current FROM changes WHERE section_id IS NOT NULL
  UNION ALL SELECT coalesce(section_id, -parsed_id), new_hash, true FROM changes WHERE change IN ('updated', 'new')""")
def reingest_snapshot(spark, sf_dir):
    return I.snapshot(*_reingest(spark, sf_dir))


@query("invalidate_by_id", f"WITH {X.CACHE_SQL} SELECT cache_id, is_valid AND cache_id % 10 <> 1 AS is_valid FROM cache")
def invalidate_by_id(spark, sf_dir):
    cache = X.answer_cache(spark, sf_dir).select("cache_id", "is_valid")
    return C.invalidated(cache, cache.where("cache_id % 10 = 1"))


@query("maintain", f"""WITH {X.CACHE_SQL}, alive AS (SELECT *, round(CAST({HITS_SQL} AS DOUBLE) * CASE WHEN cache_id % 3 = 0 THEN 0.001 ELSE 0.0001 * length(answer_text) END, 9) AS value FROM cache WHERE ttl_seconds IS NULL OR {X.AS_OF} - created_s <= ttl_seconds),
  kept AS (SELECT cache_id FROM (SELECT cache_id, row_number() OVER (ORDER BY value DESC, last_served_s DESC NULLS LAST, created_s DESC, cache_id DESC) AS n FROM alive WHERE is_valid) WHERE n <= 40 UNION ALL SELECT cache_id FROM alive WHERE NOT is_valid),
  facts AS (SELECT cache_id * 10 + k AS fact_id, cache_id, (cache_id + k) % 13 AS serve_count, created_s FROM cache CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE cache_id IN (SELECT cache_id FROM kept)),
  links AS (SELECT cache_id AS source, cache_id + 100 AS target, cache_id % 5 AS strength, created_s - CASE WHEN cache_id % 2 = 0 THEN 4000000 ELSE 0 END AS created_s FROM cache)
  SELECT 'answers' AS store, cache_id AS id FROM kept
  UNION ALL SELECT 'facts', fact_id FROM (SELECT *, row_number() OVER (ORDER BY serve_count DESC, created_s DESC, fact_id DESC) AS n FROM facts) WHERE n <= 50
  UNION ALL SELECT 'links', source FROM (SELECT *, row_number() OVER (ORDER BY strength DESC, created_s DESC, source DESC) AS n FROM links WHERE NOT (strength = 0 AND created_s < {X.AS_OF} - 2592000)) WHERE n <= 60
  UNION ALL SELECT 'audit', event_id FROM events WHERE epoch_us(ts) // 1000000 - event_id % 2 * 8000000 >= {X.AS_OF} - 7776000""")
def maintain(spark, sf_dir):
    """One job over all stores, with small caps."""
    cache = X.answer_cache(spark, sf_dir).withColumn("cost", F.when(F.col("cache_id") % 3 != 0, 0.0001 * F.length("answer_text")))
    facts = cache.select("cache_id", "created_s", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    facts = facts.select((F.col("cache_id") * 10 + F.col("k")).alias("fact_id"), "cache_id", ((F.col("cache_id") + F.col("k")) % 13).alias("serve_count"), "created_s")
    old = F.when(F.col("cache_id") % 2 == 0, 4_000_000).otherwise(0)
    links = cache.select(F.col("cache_id").alias("source"), (F.col("cache_id") + 100).alias("target"), (F.col("cache_id") % 5).alias("strength"), (F.col("created_s") - old).alias("created_s"))
    audit = table(spark, sf_dir, "events").select("event_id", (F.floor(F.unix_micros("ts") / 1_000_000) - F.col("event_id") % 2 * 8_000_000).alias("created_s"))
    left = C.maintain(cache, facts, links, audit, X.AS_OF, caps=(40, 50, 60), top=10)
    ids = {"answers": "cache_id", "facts": "fact_id", "links": "source", "audit": "event_id"}
    out = [left[store].select(F.lit(store).alias("store"), F.col(c).alias("id")) for store, c in ids.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("conversation_ratings", """SELECT conv_id AS conversation_id, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 5 + 1 END AS rating, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'last' END AS feedback FROM (SELECT DISTINCT conv_id FROM conversations)""")
def conversation_ratings(spark, sf_dir):
    """Recorded in two steps; rated twice, and once out of range."""
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id")).distinct()
    blank = ids.withColumns({"rating": F.lit(None).cast("long"), "feedback": F.lit(None).cast("string")})
    held = M.record(blank.where("conversation_id % 2 = 0"), ids)
    c = F.col("conversation_id")
    wrong = ids.select(c, F.lit(9).cast("long").alias("rating"), F.lit("refused").alias("feedback"), F.lit(3).alias("at"))
    given = ids.where(c % 5 != 0).select(c, (c % 5 + 1).alias("rating"), F.lit("last").alias("feedback"), F.lit(2).alias("at"))
    return M.rate(held, wrong.unionByName(given).unionByName(given.withColumns({"rating": F.lit(1).cast("long"), "feedback": F.lit("first"), "at": F.lit(1)})))


@query("corrections_applied", """SELECT conv_id AS correction_id, CASE conv_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, conv_id % 6 = 0 AS is_applied FROM (SELECT DISTINCT conv_id FROM conversations)""")
def corrections_applied(spark, sf_dir):
    """Corrected, reviewed, and the approved ones of even conversations applied."""
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("correction_id")).distinct()
    none = spark.createDataFrame([], "correction_id long, conversation_id long, corrected string, status string, is_applied boolean")
    held = M.correct(none, ids.select("correction_id", F.col("correction_id").alias("conversation_id"), F.lit("so").alias("corrected")))
    verdict = F.when(F.col("correction_id") % 3 == 0, "approved").when(F.col("correction_id") % 3 == 1, "rejected")
    held = M.review(held, ids.select("correction_id", verdict.alias("status")))
    return M.mark_applied(held, held.where("status = 'approved' and correction_id % 2 = 0")).select("correction_id", "status", "is_applied")


#: Nations as namespaces; some are created, renamed or deleted.
@query("namespace_changes", """SELECT n_nationkey AS namespace_id, CASE WHEN n_nationkey % 5 = 1 THEN 'renamed' ELSE n_name END AS name, n_nationkey % 4 = 0 AND n_nationkey % 5 <> 1 AND n_nationkey % 3 <> 0 OR n_nationkey % 5 = 1 AS public_fallback FROM nation WHERE n_nationkey % 5 <> 2""")
def namespace_changes(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("namespace_id"), F.col("n_name").alias("name"))
    n = F.col("namespace_id")
    held = nation.where(n % 3 != 0).select("namespace_id", "name", (n % 4 == 0).alias("public_fallback"))
    return M.change_namespaces(held, _namespace_verbs(nation))


def _namespace_verbs(nation):
    n = F.col("namespace_id")
    verb = F.when(n % 5 == 2, "delete").when((n % 5 == 1) & (n % 3 != 0), "update").when(n % 3 == 0, "create")
    name, flag = F.when(n % 5 == 1, F.lit("renamed")).otherwise(F.col("name")), F.when(n % 5 == 1, F.lit(True))
    return nation.select("namespace_id", F.lit(5).alias("at"), verb.alias("verb"), name.alias("name"), flag.alias("public_fallback")).where("verb is not null")


@query("audit_log", """SELECT sha256('namespace|' || n_nationkey || '|5|' || verb) AS event_id, 'namespace.' || verb AS action, CAST(n_nationkey AS VARCHAR) AS subject FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 2 THEN 'delete' WHEN n_nationkey % 5 = 1 AND n_nationkey % 3 <> 0 THEN 'update' WHEN n_nationkey % 3 = 0 THEN 'create' END AS verb FROM nation) WHERE verb IS NOT NULL""")
def audit_log(spark, sf_dir):
    """What such changes append to the log."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("namespace_id"), F.col("n_name").alias("name"))
    return M.audit_events(_namespace_verbs(nation), "namespace").select("event_id", "action", "subject")


@query("orphan_cleanup", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def orphan_cleanup(spark, sf_dir):
    """Facts whose source is gone."""
    sources = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(sources, "o_custkey", "left_anti").select("o_orderkey")


@query("stale_files", "SELECT doc_id, source FROM documents WHERE doc_id % 8 = 0")
def stale_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(docs.where("doc_id % 8 <> 0").select("doc_id"), "doc_id", "left_anti")


@query("files_to_index", "SELECT doc_id FROM documents WHERE doc_id % 8 = 0 OR doc_id % 5 = 0")
def files_to_index(spark, sf_dir):
    """New files, and those whose stored hash differs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    stored = docs.where("doc_id % 8 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("stored"))
    return docs.join(stored, "doc_id", "left").where(~F.col("hash").eqNullSafe(F.col("stored"))).select("doc_id")


@query("fact_store_policy", r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS raw, generate_subscripts(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS position FROM documents WHERE length(text) >= 100),
  f AS (SELECT doc_id, position, trim(raw) AS t FROM s WHERE length(trim(raw)) BETWEEN 30 AND 500 AND NOT regexp_matches(trim(raw), '(?i)^(""" + R.FILLERS + r""")\b') AND NOT ends_with(trim(raw), '?')), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS n FROM f)
  SELECT sha256(norm) AS fact_hash, count(*) - 1 AS serve_count, min(doc_id) AS source_id FROM (SELECT doc_id, """ + X.norm_sql("t") + r""" AS norm FROM k WHERE n <= 10) GROUP BY norm""")
def fact_store_policy(spark, sf_dir):
    """The first ten atomic facts of each long answer; one that says the same, once normalised, counts as a serve of the stored one."""
    from pyspark.sql import Window

    facts = R.atomic_facts(table(spark, sf_dir, "documents").where(F.length("text") >= 100), "doc_id", "text")
    first = facts.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("position"))).where("n <= 10")
    same = first.groupBy(T.normalize(F.col("fact_text")).alias("t")).agg((F.count("*") - 1).alias("serve_count"), F.min("doc_id").alias("source_id"))
    return same.select(F.sha2("t", 256).alias("fact_hash"), "serve_count", "source_id")


@query("fact_merge")
def fact_merge(spark, sf_dir):
    """The same facts, merged at a cosine over 0.95 as they are stored one after another; a test has the loop, as SQL has no hash of words like the vectors'."""
    from pyspark.sql import Window

    facts = R.atomic_facts(table(spark, sf_dir, "documents").where(F.length("text") >= 100), "doc_id", "text")
    first = facts.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("position"))).where("n <= 10")
    place = F.col("doc_id") * 10 + F.col("n")
    vectors = first.select(place.alias("fact_id"), place.alias("ord"), F.col("fact_text").alias("text"), V.hashed_embedding(F.col("fact_text")).alias("vector"))
    return stores.merged(vectors)[0]


@query("mask_secrets", "SELECT c_custkey, left(c_name, 4) || repeat('*', greatest(length(c_name) - 4, 0)) AS masked FROM customer")
def mask_secrets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.mask_secret(F.col("c_name")).alias("masked"))
