"""Conversations, corrections, namespaces and the audit log: each change is a new table made from the old one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def record(conversations: DataFrame, exchanges: DataFrame) -> DataFrame:
    """conversations with new exchanges of ids it doesn't have; unrated."""
    fresh = exchanges.join(conversations.select("conversation_id"), "conversation_id", "left_anti")
    missing = {c: F.lit(None).cast(conversations.schema[c].dataType) for c in conversations.columns if c not in fresh.columns}
    return conversations.unionByName(fresh.withColumns(missing).select(*conversations.columns))


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def rate(conversations: DataFrame, ratings: DataFrame) -> DataFrame:
    """conversations(conversation_id, rating, feedback, ...) with the last valid of ratings(conversation_id, rating, feedback, at).

    Ratings outside 1 to 5 are refused.
    """
    last = last_of(ratings.where(F.col("rating").between(1, 5)), "conversation_id", "at").select("conversation_id", F.col("rating").alias("_rating"), F.col("feedback").alias("_feedback"))
    rated = conversations.join(last, "conversation_id", "left")
    given = F.col("_rating").isNotNull()
    return rated.withColumns({"rating": F.when(given, F.col("_rating")).otherwise(F.col("rating")), "feedback": F.when(given, F.col("_feedback")).otherwise(F.col("feedback"))}).select(*conversations.columns)


def correct(corrections: DataFrame, new: DataFrame) -> DataFrame:
    """corrections with those of new(correction_id, conversation_id, corrected, kind), pending and not applied."""
    return corrections.unionByName(new.withColumns({"status": F.lit("pending"), "is_applied": F.lit(False)}).select(*corrections.columns))


def review(corrections: DataFrame, verdicts: DataFrame) -> DataFrame:
    """corrections with the status that verdicts(correction_id, status) give to pending ones."""
    met = corrections.join(verdicts.select("correction_id", F.col("status").alias("_status")), "correction_id", "left")
    return met.withColumn("status", F.when((F.col("status") == "pending") & F.col("_status").isNotNull(), F.col("_status")).otherwise(F.col("status"))).select(*corrections.columns)


def mark_applied(corrections: DataFrame, ids: DataFrame) -> DataFrame:
    """corrections with is_applied for ids(correction_id)."""
    met = corrections.join(ids.select("correction_id").distinct().withColumn("_hit", F.lit(True)), "correction_id", "left")
    return met.withColumn("is_applied", F.col("is_applied") | F.col("_hit").isNotNull()).select(*corrections.columns)


def change_namespaces(namespaces: DataFrame, changes: DataFrame) -> DataFrame:
    """namespaces(namespace_id, name, public_fallback) after changes(namespace_id, at, verb, name, public_fallback).

    Verbs: create (an id that exists isn't created again), update (null leaves a value as it is) and delete. Of each id's
    changes the last counts; a created namespace without a flag has no fallback.
    """
    last = last_of(changes, "namespace_id", "at").select("namespace_id", "verb", F.col("name").alias("_name"), F.col("public_fallback").alias("_flag"))
    both = namespaces.withColumn("_was", F.lit(True)).join(last, "namespace_id", "full")
    was, verb = F.col("_was").isNotNull(), F.col("verb")
    there = F.when(verb == "delete", False).when(verb == "create", True).otherwise(was)
    name = F.when(was & (verb != "update"), F.col("name")).otherwise(F.coalesce("_name", "name"))
    flag = F.when(was & (verb != "update"), F.col("public_fallback")).otherwise(F.coalesce("_flag", "public_fallback", F.lit(False)))
    return both.where(there).select("namespace_id", F.when(verb.isNull(), F.col("name")).otherwise(name).alias("name"), F.when(verb.isNull(), F.col("public_fallback")).otherwise(flag).alias("public_fallback"))


def audit_events(changes: DataFrame, subject: str, actor: str = "system") -> DataFrame:
    """(event_id, at, actor, action, subject): one row to append for each of changes(<id>, at, verb)."""
    key = changes.columns[0]
    action = F.concat(F.lit(f"{subject}."), "verb")
    return changes.select(F.sha2(F.concat_ws("|", F.lit(subject), F.col(key).cast("string"), F.col("at").cast("string"), "verb"), 256).alias("event_id"), "at", F.lit(actor).alias("actor"), action.alias("action"), F.col(key).cast("string").alias("subject"))
