"""Vectors and evidence: similarity search, links, facts, accumulation and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.functions import vectors as V
from larder.operators import cells
from larder.operators import evidence as E
from larder.session import table

from . import query

THRESHOLD = 0.25


def _items(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def _queries(spark, sf_dir):
    return _items(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


NEAR_SQL = """near AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)"""


@query("cosine_topk", f"WITH {NEAR_SQL} SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM near) WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    return V.search(_queries(spark, sf_dir), _items(spark, sf_dir), k=10)


@query("semantic_evidence", f"WITH {NEAR_SQL} SELECT query_id, id, similarity, rank, round(0.55 + (similarity - 0.25) * 1.5, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM near WHERE similarity >= {THRESHOLD}) WHERE rank <= 3")
def semantic_evidence(spark, sf_dir):
    """The three nearest above a threshold; a test curve stands in, as these vectors are random."""
    found = V.search(_queries(spark, sf_dir), _items(spark, sf_dir), k=3, threshold=THRESHOLD - 1e-6).where(F.col("similarity") >= THRESHOLD)
    return found.withColumn("confidence", F.round(0.55 + (F.col("similarity") - 0.25) * 1.5, 6))


@query("best_semantic_match", f"WITH {NEAR_SQL} SELECT query_id, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM near) WHERE rank = 1")
def best_semantic_match(spark, sf_dir):
    return V.search(_queries(spark, sf_dir), _items(spark, sf_dir), k=1).drop("rank")


def _links(spark, sf_dir):
    """Links learnt from near misses among each question's ten nearest, both ways."""
    near = V.search(_queries(spark, sf_dir), _items(spark, sf_dir), k=10, threshold=THRESHOLD - 1e-6).where((F.col("similarity") >= THRESHOLD) & (F.col("similarity") <= 0.41))
    forward = near.select(F.col("query_id").alias("source"), F.col("id").alias("target"), "similarity", ((F.col("query_id") + F.col("id")) % 7).alias("strength"))
    return forward.unionByName(forward.select(F.col("target").alias("source"), F.col("source").alias("target"), "similarity", "strength"))


LINKS_SQL = f"""{NEAR_SQL}, missed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM near) WHERE place <= 10 AND similarity >= {THRESHOLD} AND similarity <= 0.41),
  links AS (SELECT query_id AS source, id AS target, similarity, (query_id + id) % 7 AS strength FROM missed UNION ALL SELECT id, query_id, similarity, (query_id + id) % 7 FROM missed)"""


@query("near_miss_links", f"WITH {LINKS_SQL} SELECT * FROM links")
def near_miss_links(spark, sf_dir):
    return _links(spark, sf_dir)


@query("links_topk", f"WITH {LINKS_SQL} SELECT source, target, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) AS rank FROM links) WHERE rank <= 5")
def links_topk(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(F.desc("similarity"), "target")
    return _links(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("source", "target", "similarity", "rank")


@query("reinforce_links", f"""WITH {LINKS_SQL}, used AS (SELECT target, count(*) AS n FROM links WHERE strength > 3 GROUP BY target)
  SELECT source, links.target, strength + coalesce(n, 0) AS strength FROM links LEFT JOIN used ON links.target = used.target""")
def reinforce_links(spark, sf_dir):
    links = _links(spark, sf_dir)
    used = links.where("strength > 3").groupBy("target").agg(F.count("*").alias("n"))
    return links.join(used, "target", "left").select("source", "target", (F.col("strength") + F.coalesce("n", F.lit(0))).alias("strength"))


@query("link_2hop", f"""WITH {LINKS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) AS n FROM links),
  reverse AS (SELECT target AS source, source AS target, similarity, strength, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, source) AS n FROM links),
  starts AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 100 = 0),
  one AS (SELECT source AS start, target, similarity, strength FROM (SELECT * FROM ranked WHERE n <= 3 UNION ALL SELECT source, target, similarity, strength, n FROM reverse WHERE n <= 3) JOIN starts ON id = source WHERE target <> source),
  two AS (SELECT o.start, r.target, 2 AS hop, r.similarity * 0.15 AS confidence FROM (SELECT DISTINCT start, target FROM one) o JOIN ranked r ON r.source = o.target AND r.n <= 2 WHERE r.target <> o.start),
  every AS (SELECT start, target, 1 AS hop, similarity * 0.5 + least(strength * 0.05, 0.25) AS confidence FROM one UNION ALL SELECT * FROM two),
  nearest AS (SELECT start, target, min(hop) AS hop FROM every GROUP BY start, target),
  once AS (SELECT n.start, n.target, n.hop, max(e.confidence) AS confidence FROM nearest n JOIN every e ON n.start = e.start AND n.target = e.target AND n.hop = e.hop GROUP BY n.start, n.target, n.hop)
  SELECT start, target, hop, round(confidence, 7) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hop, round(confidence, 7) DESC, target) AS n FROM once) WHERE n <= 10""")
def link_2hop(spark, sf_dir):
    starts = _items(spark, sf_dir).where("id % 100 = 0").select("id")
    return E.two_hops(_links(spark, sf_dir), starts).withColumn("confidence", F.round("confidence", 7))


@query("fact_search_post_filter", f"WITH {NEAR_SQL} SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM near) WHERE rank <= 5 AND label % 2 = 0")
def fact_search_post_filter(spark, sf_dir):
    """The scope is applied after the top five, so fewer may be left."""
    items = _items(spark, sf_dir)
    return V.search(_queries(spark, sf_dir), items, k=5).join(items.select("id", "label"), "id").where("label % 2 = 0").select("query_id", "id", "similarity", "rank")


NEWEST_SQL = """answers AS (SELECT vec_id, (vec_id * 7919) % 100003 AS created_s FROM embeddings WHERE vec_id % 9 <> 0), newest AS (SELECT vec_id FROM answers ORDER BY created_s DESC, vec_id LIMIT 200)"""


@query("newest_semantic_match", f"WITH {NEAR_SQL}, {NEWEST_SQL} SELECT query_id, id, similarity FROM (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM near n JOIN newest ON vec_id = id WHERE similarity >= 0.1) WHERE place = 1")
def newest_semantic_match(spark, sf_dir):
    """The best match among the 200 newest valid answers: the cut comes before the similarity."""
    items = _items(spark, sf_dir)
    answers = items.select(F.col("id").alias("cache_id"), (F.col("id") * 7919 % 100_003).alias("created_s"), (F.col("id") % 9 != 0).alias("is_valid"))
    newest = E.newest_valid(answers, 200).select(F.col("cache_id").alias("id"))
    return V.search(_queries(spark, sf_dir), items.join(newest, "id", "left_semi"), k=1, threshold=0.1).select("query_id", "id", "similarity")


TOLD_SQL = """told AS (SELECT conv_id, conv_id % 4 AS project, count(*) AS turns FROM conversations GROUP BY conv_id)"""


@query("conversation_recall", f"""WITH {NEAR_SQL}, {TOLD_SQL}, met AS (SELECT n.query_id, n.id, n.similarity, row_number() OVER (PARTITION BY n.query_id ORDER BY n.similarity DESC, n.id) AS rank FROM near n JOIN told a ON a.conv_id = n.query_id JOIN told b ON b.conv_id = n.id AND a.project = b.project)
  SELECT query_id, id, similarity, rank, turns, turns % 3 = 0 AS approved FROM met JOIN told ON conv_id = id WHERE rank <= 5""")
def conversation_recall(spark, sf_dir):
    """Conversations by their vectors, within a project; what they were rated is looked up after the cut."""
    told = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")).withColumn("project", F.col("conv_id") % 4)
    vectors = _items(spark, sf_dir).select("id", "vector").join(told.withColumnRenamed("conv_id", "id"), "id")
    found = V.search(vectors.where("id % 100 = 0").withColumnRenamed("id", "query_id"), vectors, k=5, scope="project")
    return found.join(vectors.select("id", "turns"), "id").select("query_id", "id", "similarity", "rank", "turns", (F.col("turns") % 3 == 0).alias("approved"))


@query("scoped_vector_search", f"WITH {NEAR_SQL}, scoped AS (SELECT n.* FROM near n JOIN embeddings q ON n.query_id = q.vec_id WHERE q.label = n.label) SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM scoped) WHERE rank <= 5")
def scoped_vector_search(spark, sf_dir):
    """The scope is applied before the limit, within the blocks, so that a common one gathers in no task."""
    items = _items(spark, sf_dir)
    return V.search(items.where("id % 100 = 0").withColumnRenamed("id", "query_id"), items, k=5, scope="label")


@query("ivf_search")
def ivf_search(spark, sf_dir):
    """Ten nearest by a stored index of 16 cells. The usual probes are 3; these vectors have random directions, and a recall of 0.9 takes 12, as a test measures."""
    return cells.search(cells.build(_items(spark, sf_dir)), _queries(spark, sf_dir), probes=12).select("query_id", "id", "similarity", "rank")


@query("cosine_join", """WITH near AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id)
  SELECT query_id, id, round(s, 6) AS similarity FROM near WHERE s >= 0.4""")
def cosine_join(spark, sf_dir):
    """All pairs over a threshold, whole table against whole table."""
    items = _items(spark, sf_dir)
    return cells.similar(items.select(F.col("id").alias("query_id"), "vector"), items, 0.4)


@query("upsert_vectors", """WITH stored AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, vec_id AS added FROM embeddings), new AS (SELECT id, list_transform(vector, lambda x: -x) AS vector, id + 1000000 AS added FROM stored WHERE id % 10 = 0),
  rows AS (SELECT * FROM stored WHERE id % 10 <> 0 UNION ALL SELECT * FROM new)
  SELECT id, added, round(list_sum(vector), 6) AS total FROM (SELECT *, row_number() OVER (ORDER BY added DESC, id DESC) AS n FROM rows) WHERE n <= 400""")
def upsert_vectors(spark, sf_dir):
    """New vectors in the place of old ones, those of another length left out, the store cut to 400, its oldest first."""
    items = _items(spark, sf_dir).select("id", "vector", F.col("id").alias("added"))
    new = items.where("id % 10 = 0").select("id", F.transform("vector", lambda x: -x).alias("vector"), (F.col("added") + 1_000_000).alias("added"))
    short = items.where("id % 10 = 1").select("id", F.slice("vector", 1, 3).alias("vector"), (F.col("added") + 2_000_000).alias("added"))
    return V.upsert(items, new.unionByName(short), most=400).select("id", "added", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("remove_vectors", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 9 <> 0")
def remove_vectors(spark, sf_dir):
    items = _items(spark, sf_dir).select("id", "label")
    return V.remove(items, items.where("id % 9 = 0"))


def _evidence(spark, sf_dir):
    """Evidence by layer for each purchase, signup and view, from the events table."""
    e = F.col("event_id")
    layer = F.when(e % 5 == 0, "exact").when(e % 5 == 1, "semantic").when(e % 5 == 2, "composable").when(e % 5 == 3, "fuzzy").otherwise("session")
    confidence = F.when(e % 97 == 0, -0.5).when(e % 5 == 0, F.when(e % 3 == 0, 1.0).otherwise(0.0)).when(e % 5 == 1, (e % 90) / 100.0).when(e % 5 == 2, 0.85).when(e % 5 == 3, 0.40).otherwise(0.25)
    return table(spark, sf_dir, "events").select(F.floor(e / 7).cast("long").alias("question_id"), layer.alias("layer"), (e % 7).alias("ord"), confidence.alias("confidence"), F.when(e % 11 == 0, "").otherwise(F.concat("event_type", F.lit(" "), e)).alias("text"), (e % 5 >= 3).alias("is_partial"))


EVIDENCE_SQL = """evidence AS (SELECT event_id // 7 AS question_id, CASE event_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' WHEN 2 THEN 'composable' WHEN 3 THEN 'fuzzy' ELSE 'session' END AS layer, event_id % 7 AS ord,
  CASE WHEN event_id % 97 = 0 THEN -0.5 WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END WHEN event_id % 5 = 1 THEN CAST(event_id % 90 AS DOUBLE) / 100 WHEN event_id % 5 = 2 THEN 0.85 WHEN event_id % 5 = 3 THEN 0.40 ELSE 0.25 END AS confidence,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' ' || event_id END AS text, event_id % 5 >= 3 AS is_partial FROM events),
  summed AS (SELECT question_id, round(least(1.0, greatest(0.0, 1 - product(CASE WHEN confidence > 0 THEN CAST(1 - confidence AS DOUBLE) ELSE 1.0 END) - sum(CASE WHEN confidence < 0 THEN CAST(-confidence AS DOUBLE) ELSE 0.0 END))), 6) AS confidence, count(*) AS n FROM evidence GROUP BY question_id)"""


@query("evidence_accumulate", f"WITH {EVIDENCE_SQL} SELECT question_id, confidence, n FROM summed")
def evidence_accumulate(spark, sf_dir):
    return E.accumulate(_evidence(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("best_answer", f"WITH {EVIDENCE_SQL} SELECT question_id, layer, ord, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, ord) AS n FROM evidence WHERE NOT is_partial) WHERE n = 1")
def best_answer(spark, sf_dir):
    return E.best_answer(_evidence(spark, sf_dir))


@query("context_assembly", f"WITH {EVIDENCE_SQL} SELECT question_id, string_agg('[' || layer || ':' || printf('%.2f', CAST(confidence AS DOUBLE)) || ']' || CASE WHEN layer = 'composable' THEN ' (re: part ' || ord || ')' ELSE '' END || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY confidence DESC, ord) AS context FROM evidence WHERE text <> '' GROUP BY question_id")
def context_assembly(spark, sf_dir):
    part = F.when(F.col("layer") == "composable", F.concat(F.lit("part "), "ord"))
    return E.context(_evidence(spark, sf_dir).withColumn("sub_query", part))


@query("decision_accumulate", f"""WITH {EVIDENCE_SQL}, whole AS (SELECT DISTINCT question_id FROM evidence WHERE NOT is_partial), questions AS (SELECT event_id AS question_id FROM events WHERE event_id < (SELECT count(*) FROM events) // 5)
  SELECT q.question_id, coalesce(s.confidence, 0.0) AS confidence, CASE WHEN s.confidence >= 0.95 AND w.question_id IS NOT NULL THEN 'SERVE' WHEN s.n > 0 THEN 'GENERATE_WITH_CONTEXT' ELSE 'GENERATE' END AS decision
  FROM questions q LEFT JOIN summed s ON q.question_id = s.question_id LEFT JOIN whole w ON q.question_id = w.question_id""")
def decision_accumulate(spark, sf_dir):
    return E.decide(_evidence(spark, sf_dir), _questions(spark, sf_dir))


def _questions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    many = events.agg(F.floor(F.count("*") / 5).alias("n"))
    return events.crossJoin(F.broadcast(many)).where("event_id < n").select(F.col("event_id").alias("question_id"))  # many: one row


@query("decision_first_hit", f"""WITH {EVIDENCE_SQL}, questions AS (SELECT event_id AS question_id FROM events WHERE event_id < (SELECT count(*) FROM events) // 5),
  good AS (SELECT question_id, layer, CASE layer WHEN 'exact' THEN 1 WHEN 'composable' THEN 2 ELSE 3 END AS place FROM evidence WHERE confidence >= CASE layer WHEN 'exact' THEN 1.0 WHEN 'composable' THEN 0.85 WHEN 'semantic' THEN 0.8 ELSE 2 END),
  first AS (SELECT question_id, layer FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place) AS n FROM good) WHERE n = 1)
  SELECT q.question_id, f.layer FROM questions q LEFT JOIN first f ON q.question_id = f.question_id""")
def decision_first_hit(spark, sf_dir):
    return E.first_hit(_evidence(spark, sf_dir), _questions(spark, sf_dir), ["exact", "composable", "semantic"], {"exact": 1.0, "composable": 0.85, "semantic": 0.8})


@query("short_circuit_layers", f"""WITH {EVIDENCE_SQL}, part AS (SELECT * FROM evidence WHERE NOT (layer = 'composable' AND question_id % 3 = 0)), exact AS (SELECT DISTINCT question_id FROM part WHERE layer = 'exact' AND confidence >= 1.0),
  rest AS (SELECT e.* FROM part e WHERE NOT EXISTS (SELECT 1 FROM exact x WHERE x.question_id = e.question_id)), composed AS (SELECT DISTINCT question_id FROM rest WHERE layer = 'composable')
  SELECT layer, count(*) AS n, count(DISTINCT question_id) AS questions FROM rest WHERE layer NOT IN ('exact', 'composable') AND NOT EXISTS (SELECT 1 FROM composed c WHERE c.question_id = rest.question_id) GROUP BY layer""")
def short_circuit_layers(spark, sf_dir):
    """What later layers still see: questions that earlier layers served are taken out between them. A third of them can't be composed."""
    evidence = _evidence(spark, sf_dir).where("not (layer = 'composable' and question_id % 3 = 0)")
    rest = evidence.join(evidence.where("layer = 'exact' and confidence >= 1.0").select("question_id"), "question_id", "left_anti")
    rest = rest.join(rest.where("layer = 'composable'").select("question_id"), "question_id", "left_anti")
    return rest.where("layer not in ('exact', 'composable')").groupBy("layer").agg(F.count("*").alias("n"), F.countDistinct("question_id").alias("questions"))
