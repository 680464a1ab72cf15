"""Answer-cache layers as joins: exact, verified, composable, fuzzy, and what becomes of expired or replaced records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators.project import compared
from larder.operators.ranking import TOP, keep_most_valuable
from larder.storage import spill


def expired(created_s: Column, ttl: Column, as_of: Column) -> Column:
    """No lifetime: never. No creation time: always. Else once strictly more time has passed."""
    return F.when(ttl.isNull(), False).when(created_s.isNull(), True).otherwise(as_of - created_s > ttl)


def exact_lookup(asks: DataFrame) -> DataFrame:
    """asks(key, asked_s, question_id, ...) with hit and source_id: the first ask of a key pays, all later ones hit.

    The first is a minimum, combined on the map side, and the join back is one that adaptive execution can split: a question
    that a third of all asks repeat isn't one task's work. question_id is unique.
    """
    first = asks.groupBy("key").agg(F.min(F.struct("asked_s", "question_id")).alias("_first"))
    met = asks.join(first, "key")
    return met.withColumn("hit", F.struct("asked_s", "question_id") != F.col("_first")).withColumn("source_id", F.col("_first.question_id")).drop("_first")


def verify(cache: DataFrame, sections: DataFrame) -> DataFrame:
    """cache(cache_id, source_sections) with verified: every manifest entry's hash is that of the current section.

    An entry without a hash, or of an unknown section, is stale; a record without sources is verified.
    """
    entries = cache.select("cache_id", F.explode("source_sections").alias("s")).select("cache_id", "s.section_id", F.col("s.version_hash").alias("expected"))
    current = sections.where("is_current").select("section_id", "version_hash")
    checked = entries.join(current, "section_id", "left").groupBy("cache_id").agg(F.bool_and(F.coalesce(F.col("expected") == F.col("version_hash"), F.lit(False))).alias("ok"))
    return cache.join(checked, "cache_id", "left").withColumn("verified", F.coalesce("ok", F.lit(True))).drop("ok")


def upsert(cache: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One record per key, the last by `order`."""
    rows = cache.unionByName(new)
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def split_on_and(question: Column) -> Column:
    """Array of the two sub-questions around a comparison word or `and`; null if the question has none."""
    pattern = r"(?is)^(.+?)\b(?:compare|compared?\s+to|differences?\s+between|vs\.?|versus|and)\b(.+)$"
    side = lambda i: F.trim(F.regexp_replace(F.trim(F.regexp_extract(question, pattern, i)), "^,+|,+$", ""))
    a, b = side(1), side(2)
    verbs = ["find", "show", "list", "get", "give", "tell", "search"]
    return F.when((F.length(a) >= 3) & (F.length(b) >= 3) & ~F.lower(F.split(a, r"\s+")[0]).isin(verbs), F.array(a, b))


def sub_questions(asks: DataFrame) -> DataFrame:
    """(question_id, position, sub_question, filters) from asks(question_id, question, filters).

    A question that compares things has one for each, whose filters also name it as `entity`; else one on each side of `and`.
    """
    items = compared(asks, "question_id", "question").join(asks.select("question_id", "filters"), "question_id")
    named = items.select("question_id", "position", "sub_question", F.map_concat(F.map_filter("filters", lambda k, _: k != "entity"), F.create_map(F.lit("entity"), F.col("item"))).alias("filters"))
    plain = asks.join(items.select("question_id").distinct(), "question_id", "left_anti").select("question_id", "filters", F.posexplode(split_on_and(F.col("question"))).alias("position", "sub_question"))
    return named.unionByName(plain.select("question_id", F.col("position").cast("long").alias("position"), "sub_question", "filters"))


def composable_lookup(asks: DataFrame, cache: DataFrame) -> DataFrame:
    """(question_id, position, sub_question, cache_id, scoped): the record of each sub-question, under its filters, else without.

    cache(cache_id, key): of records of one key the least id counts. cache_id is null where neither key is known.
    """
    first = cache.groupBy("key").agg(F.min("cache_id").alias("cache_id"))
    subs = sub_questions(asks)
    keyed = subs.withColumns({"key": T.scoped_key(F.col("sub_question"), F.col("filters")), "open_key": T.scoped_key(F.col("sub_question"), F.create_map().cast("map<string,string>"))})
    found = keyed.join(first.withColumnRenamed("cache_id", "own"), "key", "left").join(first.select(F.col("key").alias("open_key"), F.col("cache_id").alias("any")), "open_key", "left")
    return found.select("question_id", "position", "sub_question", F.coalesce("own", "any").alias("cache_id"), F.col("own").isNotNull().alias("scoped"))


def composed(found: DataFrame) -> DataFrame:
    """(question_id, parts, hits, outcome) of looked-up sub-questions: complete, partial or miss."""
    sums = found.groupBy("question_id").agg(F.count("*").alias("parts"), F.count("cache_id").alias("hits"))
    return sums.withColumn("outcome", F.when(F.col("hits") == F.col("parts"), "complete").when(F.col("hits") > 0, "partial").otherwise("miss"))


def stats(cache: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts, hit rate (serves over serves and entries never served, per cent), and generation time saved by valid entries."""
    never = F.count_if(F.col("serve_count") == 0)
    serves = F.sum("serve_count")
    saved = F.sum(F.when(F.col("is_valid"), F.col("generation_ms") * F.col("serve_count")).otherwise(0.0))
    return cache.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalidated"),
        serves.alias("total_serves"),
        F.round(F.least(F.lit(100.0), 100.0 * serves / F.greatest(serves + never, F.lit(1))), 1).alias("hit_rate"),
        F.round(saved, 2).alias("saved_ms"),
        F.round(F.avg("generation_ms"), 1).alias("avg_generation_ms"),
    )


def predicted_hits(serve_count: Column, created_s: Column, last_served_s: Column, as_of: Column) -> Column:
    """Hits expected in the next day: the hourly rate so far, halved for each day since the last serve."""
    hours = F.greatest((as_of - last_served_s) / 3600.0, F.lit(0.001))
    rate = F.when(created_s.isNull(), 0.1).otherwise(serve_count / F.greatest((as_of - created_s) / 3600.0, F.lit(1.0)))
    return F.when(last_served_s.isNull(), 0.1).otherwise(rate * F.pow(F.lit(2.0), -hours / 24.0) * 24)


def invalidated(cache: DataFrame, ids: DataFrame) -> DataFrame:
    """cache with is_valid false for the records of ids(cache_id), by whatever rule they were found."""
    hit = ids.select("cache_id").distinct().withColumn("_hit", F.lit(True))
    return cache.join(hit, "cache_id", "left").withColumn("is_valid", F.col("is_valid") & F.col("_hit").isNull()).drop("_hit")


#: What a store keeps at most, and for how many days weak links and audit events stay.
MOST_ANSWERS, MOST_FACTS, MOST_LINKS = 100_000, 500_000, 1_000_000
WEAK_DAYS, AUDIT_DAYS = 30, 90


def maintain(answers: DataFrame, facts: DataFrame, links: DataFrame, audit: DataFrame, as_of: int, caps: tuple[int, int, int] = (MOST_ANSWERS, MOST_FACTS, MOST_LINKS), top: int = TOP) -> dict[str, DataFrame]:
    """What is left of each store after one maintenance job at as_of, in seconds; nothing is changed in place.

    Expired answers go, then valid ones over the cap, those of least predicted value first; facts without an answer, then
    facts over the cap, least served first; links without strength that are old, then links over the cap; old audit events.
    answers(cache_id, is_valid, serve_count, created_s, last_served_s, ttl_seconds, cost), facts(fact_id, cache_id, serve_count,
    created_s), links(source, target, strength, created_s), audit(event_id, created_s).
    """
    now = F.lit(as_of)
    alive = spill(answers.where(~expired(F.col("created_s"), F.col("ttl_seconds"), now)))
    hits = predicted_hits(F.col("serve_count"), F.col("created_s"), F.col("last_served_s"), now)
    value = F.round(hits * F.when(F.coalesce("cost", F.lit(0.0)) > 0, F.col("cost")).otherwise(F.lit(0.001)), 9)
    valued = alive.where("is_valid").withColumn("_value", value)
    best = keep_most_valuable(valued, caps[0], F.desc("_value"), F.desc_nulls_last("last_served_s"), F.desc("created_s"), F.desc("cache_id"), top=top).drop("_value")
    kept = spill(best.unionByName(alive.where("not is_valid")))
    owned = facts.join(kept.select("cache_id"), "cache_id", "left_semi")
    strong = links.where(~((F.col("strength") == 0) & (F.col("created_s") < as_of - WEAK_DAYS * 86_400)))
    return {
        "answers": kept,
        "facts": keep_most_valuable(owned, caps[1], F.desc("serve_count"), F.desc("created_s"), F.desc("fact_id"), top=top),
        "links": keep_most_valuable(strong, caps[2], F.desc("strength"), F.desc("created_s"), F.desc("source"), F.desc("target"), top=top),
        "audit": audit.where(F.col("created_s") >= as_of - AUDIT_DAYS * 86_400),
    }
