"""Analytics: usage, prices, benchmark reports, simulations and document statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators import analytics as A
from larder.operators import cache as C
from larder.operators import counters as N
from larder.plans import fixtures as X
from larder.session import table
from larder.storage import spill

from . import query

RATES_SQL = "CASE WHEN model LIKE 'gpt-4o-mini%' THEN {0} WHEN model LIKE 'gpt-4-turbo%' THEN {1} WHEN model LIKE 'claude-3-haiku%' THEN {2} WHEN model LIKE 'llama3.2%' THEN {3} ELSE {4} END"
PRICED_SQL = f"""{X.USAGE_SQL}, priced AS (SELECT *, floor(input_tokens * CAST({RATES_SQL.format(0.15, 10.0, 0.25, 0.0, 0.5)} AS DOUBLE) + output_tokens * CAST({RATES_SQL.format(0.6, 30.0, 1.25, 0.0, 1.5)} AS DOUBLE) + 0.5) / 1e6 AS cost FROM usage)"""


def _priced(spark, sf_dir):
    return A.priced(X.usage(spark, sf_dir), A.prices(spark))


SUMMARY_SQL = """count(*) AS requests, count(*) FILTER (WHERE cached) AS hits, round(100.0 * count(*) FILTER (WHERE cached) / count(*), 2) AS hit_rate_pct, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(CASE WHEN cached THEN 0.0 ELSE cost END), 6) AS cost, round(sum(CASE WHEN cached THEN cost ELSE 0.0 END), 6) AS savings"""


def _summary():
    return [
        F.count("*").alias("requests"),
        F.count_if("cached").alias("hits"),
        F.round(100.0 * F.count_if("cached") / F.count("*"), 2).alias("hit_rate_pct"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum(F.when(F.col("cached"), 0.0).otherwise(F.col("cost"))), 6).alias("cost"),
        F.round(F.sum(F.when(F.col("cached"), F.col("cost")).otherwise(0.0)), 6).alias("savings"),
    ]


@query("usage_summary", f"WITH {PRICED_SQL} SELECT {SUMMARY_SQL} FROM priced")
def usage_summary(spark, sf_dir):
    return _priced(spark, sf_dir).agg(*_summary())


@query("usage_daily", f"WITH {PRICED_SQL} SELECT CAST(ts AS DATE) AS day, {SUMMARY_SQL} FROM priced GROUP BY CAST(ts AS DATE)")
def usage_daily(spark, sf_dir):
    return _priced(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(*_summary())


@query("pricing_prefix_join", f"WITH {PRICED_SQL} SELECT event_id, model, cost FROM priced")
def pricing_prefix_join(spark, sf_dir):
    return _priced(spark, sf_dir).select("event_id", "model", "cost")


@query("top_models", f"WITH {PRICED_SQL} SELECT model, count(*) AS requests, round(sum(cost), 6) AS cost FROM priced GROUP BY model ORDER BY requests DESC, model LIMIT 10")
def top_models(spark, sf_dir):
    """A top-10 report."""
    return _priced(spark, sf_dir).groupBy("model").agg(F.count("*").alias("requests"), F.round(F.sum("cost"), 6).alias("cost")).orderBy(F.desc("requests"), "model").limit(10)


@query("usage_by_tenant", f"WITH {PRICED_SQL} SELECT tenant_id, layer, {SUMMARY_SQL} FROM priced GROUP BY tenant_id, layer")
def usage_by_tenant(spark, sf_dir):
    return _priced(spark, sf_dir).groupBy("tenant_id", "layer").agg(*_summary())


@query("benchmark_report", f"""WITH {PRICED_SQL} SELECT layer, count(*) AS n, count(*) FILTER (cached) AS hits, round(100.0 * count(*) FILTER (cached) / count(*), 2) AS hit_rate, CAST(coalesce(sum(input_tokens + output_tokens) FILTER (cached), 0) AS BIGINT) AS saved_tokens,
  round(coalesce(sum(cost) FILTER (cached), 0.0), 4) AS saved_cost, round(coalesce(sum(cost) FILTER (NOT cached), 0.0), 4) AS paid, round(avg(latency_ms), 4) AS mean, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99 FROM priced GROUP BY layer""")
def benchmark_report(spark, sf_dir):
    """Hits, savings and latencies by layer."""
    rows = _priced(spark, sf_dir)
    hit = F.col("cached")
    sums = rows.groupBy("layer").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(100.0 * F.count_if(hit) / F.count("*"), 2).alias("hit_rate"), F.coalesce(F.sum(F.when(hit, F.col("input_tokens") + F.col("output_tokens"))), F.lit(0)).alias("saved_tokens"),
        F.round(F.coalesce(F.sum(F.when(hit, F.col("cost"))), F.lit(0.0)), 4).alias("saved_cost"), F.round(F.coalesce(F.sum(F.when(~hit, F.col("cost"))), F.lit(0.0)), 4).alias("paid"), F.round(F.avg("latency_ms"), 4).alias("mean"),
    )
    found = A.percentiles(rows, "layer", "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return sums.join(found, "layer", "left").select(*sums.columns, *(F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")))


@query("benchmark_projection", f"""WITH {PRICED_SQL} SELECT round(avg(CASE WHEN cached THEN latency_ms END), 4) AS cached_ms, round(avg(CASE WHEN NOT cached THEN latency_ms END), 4) AS model_ms, round(avg(CASE WHEN NOT cached THEN latency_ms END) / avg(CASE WHEN cached THEN latency_ms END), 2) AS speedup,
  round(sum(CASE WHEN cached THEN 0.0 ELSE cost END) / count(*) * 100000 * 30, 2) AS monthly_cost FROM priced""")
def benchmark_projection(spark, sf_dir):
    hit, miss = F.avg(F.when(F.col("cached"), F.col("latency_ms"))), F.avg(F.when(~F.col("cached"), F.col("latency_ms")))
    paid = F.sum(F.when(F.col("cached"), 0.0).otherwise(F.col("cost")))
    return _priced(spark, sf_dir).agg(F.round(hit, 4).alias("cached_ms"), F.round(miss, 4).alias("model_ms"), F.round(miss / hit, 2).alias("speedup"), F.round(paid / F.count("*") * 100_000 * 30, 2).alias("monthly_cost"))


@query("stress_metrics", """SELECT event_type AS category, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error' AND event_id % 20 <> 0) AS success, round(list_sort(list(value))[least(CAST(floor(count(*) * 0.5) AS INTEGER), CAST(count(*) AS INTEGER) - 1) + 1], 6) AS p50,
  round(list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS INTEGER), CAST(count(*) AS INTEGER) - 1) + 1], 6) AS p95 FROM events GROUP BY event_type""")
def stress_metrics(spark, sf_dir):
    """Nearest-rank percentiles."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "category")
    totals = events.groupBy("category").agg(F.count("*").alias("n"), F.count_if((F.col("category") != "error") & (F.col("event_id") % 20 != 0)).alias("success"))
    found = A.percentiles(events, "category", "value", {"p50": 0.5, "p95": 0.95}, nearest=True)
    return totals.join(found, "category", "left").select("category", "n", "success", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("stress_errors", "SELECT left(props, 80) AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, error LIMIT 5")
def stress_errors(spark, sf_dir):
    """A top-5 report."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.left("props", F.lit(80)).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(5)


@query("population_sim", """WITH asked AS (SELECT *, row_number() OVER (PARTITION BY props ORDER BY ts, event_id) AS n FROM events)
  SELECT user_id, count(*) AS asked, count(*) FILTER (WHERE n > 1) AS hits, round(100.0 * count(*) FILTER (WHERE n > 1) / count(*), 2) AS saved_pct FROM asked GROUP BY user_id""")
def population_sim(spark, sf_dir):
    """The first to ask a question pays, later ones hit."""
    asked = C.exact_lookup(table(spark, sf_dir, "events").select("user_id", F.col("props").alias("key"), F.col("ts").alias("asked_s"), F.col("event_id").alias("question_id")))
    hits = F.count_if("hit")
    return asked.groupBy("user_id").agg(F.count("*").alias("asked"), hits.alias("hits"), F.round(100.0 * hits / F.count("*"), 2).alias("saved_pct"))


@query("query_share", """WITH c AS (SELECT props, count(*) AS n FROM events GROUP BY props), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, props) AS r, count(*) OVER () AS k FROM c)
  SELECT max(k) AS distinct_queries, round(CAST(sum(CASE WHEN r <= greatest(1, CAST(floor(k * 0.2) AS BIGINT)) THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS top_share FROM r""")
def query_share(spark, sf_dir):
    """The share of the most frequent fifth of distinct questions: by counts of counts, so that no row is ranked alone."""
    counts = table(spark, sf_dir, "events").groupBy("props").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("of"))
    total = counts.agg(F.sum("of").alias("k"), F.sum(F.col("n") * F.col("of")).alias("rows"))
    before = F.coalesce(F.sum("of").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("before", before).crossJoin(F.broadcast(total))  # total: one row
    taken = F.least(F.col("of"), F.greatest(F.greatest(F.lit(1), F.floor(F.col("k") * 0.2)) - F.col("before"), F.lit(0)))
    return ranked.agg(F.max("k").alias("distinct_queries"), F.round(F.sum(taken * F.col("n")).cast("double") / F.max("rows"), 6).alias("top_share"))


@query("document_stats", """SELECT p_brand AS document, count(DISTINCT p_partkey) AS sections, count(l_orderkey) AS chunks FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand""")
def document_stats(spark, sf_dir):
    """Chunks are counted for each section before the join, so that it doesn't fan out."""
    chunks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    sections = table(spark, sf_dir, "part").join(chunks, "p_partkey", "left")
    return sections.groupBy(F.col("p_brand").alias("document")).agg(F.count("*").alias("sections"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


@query("document_totals", "SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def document_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("quality_score", r"""SELECT doc_id, round(0.4 * least(1.0, words / 200.0) + 0.35 * least(1.0, sentences / 5.0) + 0.25 * d, 4) AS score FROM (SELECT doc_id, len(ws) AS words, len(regexp_extract_all(text, '[.!?]')) AS sentences, CAST(len(list_distinct(ws)) AS DOUBLE) / greatest(len(ws), 1) AS d
  FROM (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents))""")
def quality_score(spark, sf_dir):
    """Weighted relevance, completeness and coherence, here by words, sentences and diversity."""
    words = F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: w != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("words"), F.regexp_count("text", F.lit("[.!?]")).alias("sentences"), (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))).alias("d"))
    return rows.select("doc_id", F.round(0.4 * F.least(F.lit(1.0), F.col("words") / 200.0) + 0.35 * F.least(F.lit(1.0), F.col("sentences") / 5.0) + 0.25 * F.col("d"), 4).alias("score"))


@query("latency_histogram", f"""WITH {X.USAGE_SQL} SELECT layer, CASE WHEN latency_ms < 10 THEN 10 WHEN latency_ms < 50 THEN 50 WHEN latency_ms < 100 THEN 100 WHEN latency_ms < 500 THEN 500 ELSE 1000000 END AS bucket, count(*) AS n FROM usage GROUP BY 1, 2""")
def latency_histogram(spark, sf_dir):
    v = F.col("latency_ms")
    bucket = F.when(v < 10, 10).when(v < 50, 50).when(v < 100, 100).when(v < 500, 500).otherwise(1_000_000)
    return X.usage(spark, sf_dir).groupBy("layer", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("pricing_stale", f"WITH {X.USAGE_SQL} SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 7 AS stale FROM usage")
def pricing_stale(spark, sf_dir):
    return X.usage(spark, sf_dir).select("event_id", (F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")) > 7).alias("stale"))


LAYERS = ["view", "click", "signup"]
SERIES_SQL = f"""WITH {PRICED_SQL}, rows AS (SELECT CASE WHEN layer IN ('view', 'click', 'signup') THEN layer ELSE 'other' END AS layer, cached, latency_ms, cost FROM priced),
  bounds AS (SELECT CAST(unnest([1, 5, 10, 50, 100, 500, 1000, 5000]) AS DOUBLE) AS bound)
  SELECT 'hits_total' AS metric, layer, CAST(NULL AS DOUBLE) AS bound, CAST(count(*) FILTER (cached) AS DOUBLE) AS value FROM rows GROUP BY layer
  UNION ALL SELECT 'misses_total', layer, NULL, CAST(count(*) FILTER (NOT cached) AS DOUBLE) FROM rows GROUP BY layer
  UNION ALL SELECT 'cost_saved_total', layer, NULL, round(sum(CASE WHEN cached THEN cost ELSE 0.0 END), 4) FROM rows GROUP BY layer
  UNION ALL SELECT 'latency_bucket', layer, bound, CAST(count(*) FILTER (latency_ms <= bound) AS DOUBLE) FROM rows CROSS JOIN bounds GROUP BY layer, bound
  UNION ALL SELECT 'latency_sum', layer, NULL, round(sum(latency_ms), 4) FROM rows GROUP BY layer
  UNION ALL SELECT 'latency_count', layer, NULL, CAST(count(latency_ms) AS DOUBLE) FROM rows GROUP BY layer"""


@query("usage_series", SERIES_SQL)
def usage_series(spark, sf_dir):
    """Counters and histograms by layer, taken while the priced records are written."""
    rows, seen = N.observed(_priced(spark, sf_dir).withColumn("saved", F.when(F.col("cached"), F.col("cost")).otherwise(F.lit(0.0))), N.counters(LAYERS))
    spill(rows)
    return N.series(spark, seen).withColumn("value", F.round("value", 4))
