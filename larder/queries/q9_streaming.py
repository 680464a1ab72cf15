"""Streams run to completion over the events table; SQL gives the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.session import table
from larder.storage import fresh
from larder.streaming import streams as S

from . import query


@query("stream_usage_daily", "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_usage_daily(spark, sf_dir):
    return S.run_once(S.daily_usage(S.events_stream(spark, sf_dir)), "complete")


@query("stream_debounce", """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 300000000 THEN 1 ELSE 0 END AS opens FROM events),
  s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 5 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, burst""")
def stream_debounce(spark, sf_dir):
    return S.run_once(S.debounced(S.events_stream(spark, sf_dir)), "complete")


@query("stream_rate_limit", """SELECT start, user_id, count(*) AS n FROM (SELECT user_id, make_timestamp((epoch_us(ts) // 21600000000 - k) * 21600000000) AS start FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k)) GROUP BY start, user_id""")
def stream_rate_limit(spark, sf_dir):
    return S.run_once(S.request_rates(S.events_stream(spark, sf_dir)), "complete")


#: A breaker in SQL: each call by recursion over its key's calls; two failures in a row, a day, one probe.
BREAKER_SQL = """RECURSIVE calls AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type IN ('error', 'click') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  steps AS (
    SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 'closed' AS state, CAST(0 AS BIGINT) AS bad, CAST(0 AS BIGINT) AS opened, CAST(0 AS BIGINT) AS tried, '' AS shown, false AS admitted FROM (SELECT DISTINCT user_id FROM calls)
    UNION ALL
    SELECT user_id, i, event_id, CASE WHEN NOT admitted THEN now WHEN NOT failed THEN 'closed' WHEN now = 'half_open' OR bad + 1 >= 2 THEN 'open' ELSE now END, CASE WHEN NOT admitted THEN bad WHEN NOT failed THEN 0 ELSE bad + 1 END,
           CASE WHEN admitted AND failed AND (now = 'half_open' OR bad + 1 >= 2) THEN us ELSE opened END, CASE WHEN admitted AND now = 'half_open' THEN tries + 1 ELSE tries END, now, admitted
    FROM (SELECT *, now = 'closed' OR now = 'half_open' AND tries < 1 AS admitted FROM (
      SELECT c.user_id, c.i, c.event_id, c.us, c.failed, s.bad, s.opened, CASE WHEN s.state = 'open' AND c.us - s.opened >= 86400000000 THEN 'half_open' ELSE s.state END AS now,
             CASE WHEN s.state = 'open' AND c.us - s.opened >= 86400000000 THEN 0 ELSE s.tried END AS tries FROM steps s JOIN calls c ON c.user_id = s.user_id AND c.i = s.i + 1)))"""


@query("stream_breaker", f"""WITH {BREAKER_SQL}, mark AS (SELECT max(epoch_us(ts)) - 3600000000 AS us FROM events), last AS (SELECT user_id, max_by(state, i) AS state, max_by(bad, i) AS bad, max_by(opened, i) AS opened FROM steps GROUP BY user_id)
  SELECT user_id, CASE WHEN state = 'open' AND opened + 86400000000 <= us THEN 'half_open' ELSE state END AS state, bad AS failures_in_row FROM last CROSS JOIN mark""")
def stream_breaker(spark, sf_dir):
    events = S.events_stream(spark, sf_dir).withColumn("failed", F.col("event_type").isin("error", "click"))
    return S.run_once(S.breaker_states(events, failures=2, seconds=86_400, probes=1), "update", "user_id")


#: The exact limiter in SQL: each request by recursion over its client's.
LIMIT_SQL = """WITH RECURSIVE asked AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  steps AS (
    SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS recent, false AS allowed FROM (SELECT DISTINCT user_id FROM asked)
    UNION ALL
    SELECT user_id, i, event_id, CASE WHEN len(kept) < 2 THEN list_append(kept, us) ELSE kept END, len(kept) < 2
    FROM (SELECT a.user_id, a.i, a.event_id, a.us, list_filter(s.recent, lambda x: x > a.us - 43200000000) AS kept FROM steps s JOIN asked a ON a.user_id = s.user_id AND a.i = s.i + 1))
  SELECT user_id, event_id, allowed FROM steps WHERE i > 0"""


@query("stream_limiter", LIMIT_SQL)
def stream_limiter(spark, sf_dir):
    """The exact limiter with state: refused requests don't count."""
    return S.run_once(S.limited(S.events_stream(spark, sf_dir), "user_id", "ts", "event_id", 43_200, 2), "append")


@query("stream_poll", """SELECT CAST(n AS BIGINT) AS n, doc_id AS path, change FROM (
  SELECT 0 AS n, doc_id, 'new' AS change FROM documents WHERE doc_id % 6 <> 0
  UNION ALL SELECT 1, doc_id, CASE doc_id % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'deleted' ELSE 'changed' END FROM documents WHERE doc_id % 6 < 3
  UNION ALL SELECT 2, doc_id, CASE doc_id % 6 WHEN 1 THEN 'new' ELSE 'deleted' END FROM documents WHERE doc_id % 6 IN (1, 3))""")
def stream_poll(spark, sf_dir):
    """Three rounds of file events, each read by a stream that starts again from where it was: files found, gone, written again, and written as they were."""
    docs, folder = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash")), fresh(spark, "watch")
    kind = F.col("path") % 6
    again = F.when(kind == 2, "written again").otherwise(F.col("hash"))
    rounds = [docs.where(kind != 0).withColumn("deleted", F.lit(False)), docs.where(kind < 3).select("path", again.alias("hash"), (kind == 1).alias("deleted")), docs.where(kind.isin(1, 3, 4)).withColumn("deleted", kind == 3)]
    for i, rows in enumerate(rounds):
        rows.withColumn("seen", F.lit(i)).write.mode("append").parquet(f"{folder}/events")
        S.watch(spark.readStream.schema("path long, hash string, deleted boolean, seen int").parquet(f"{folder}/events"), folder)
    return S.changes(spark, folder).select(F.col("n").cast("long").alias("n"), F.col("path").cast("long").alias("path"), "change")


@query("polling_diff", """SELECT doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN 'new' WHEN doc_id % 6 = 1 THEN 'deleted' ELSE 'changed' END AS change FROM documents WHERE doc_id % 6 < 3""")
def polling_diff(spark, sf_dir):
    """Two polls of a folder: the second finds files that are new, gone or written again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    folder = fresh(spark, "poll")
    S.poll(docs.where("path % 6 <> 0"), folder)
    return S.poll(docs.where("path % 6 <> 1").withColumn("hash", F.when(F.col("path") % 6 == 2, "written again").otherwise(F.col("hash"))), folder)


@query("counter_gates", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 10 = 0")
def counter_gates(spark, sf_dir):
    """Each tenth write of a tenant."""
    return S.gates(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).where("opens").select("event_id", "user_id")
