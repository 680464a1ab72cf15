"""Fusion of keyword scores with vectors; the scores come from the written index of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import vectors as V

#: Decimals of a fused score.
DIGITS = 4


def _best(scored: DataFrame, value: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(value), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(keyword: DataFrame, queries: DataFrame, sections: DataFrame, key: str = "doc_id", weights: tuple[float, float] = (0.4, 0.6), k: int = 10) -> DataFrame:
    """(query_id, key, score, rank): keyword scores and the nearest vector of each section, each scaled to [0, 1] for a query.

    keyword(query_id, key, score), queries(query_id, vector), sections(id, vectors). What has only one of them counts as 0 in
    the other; a query without a vector goes by keywords alone. Scores are rounded before they are ranked, so besides keyword
    hits only the k first sections by rounded scores can be among the k best, and these needn't be the k nearest; no other
    pair is made. The lowest and highest similarity are those of all sections.
    """
    # Similarities lie within 2 of each other, so what is further from the k-th than this has a lower score once rounded.
    within = 2 * 10**-DIGITS / weights[1] + 1e-6 if weights[1] > 0 else 2.0
    found, extremes = V.near_sections(queries, sections, k, within)
    v = F.when(F.col("similarity").isNull(), 0.0).when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("similarity") - F.col("low")) / (F.col("high") - F.col("low")))
    alone = found.join(extremes, "query_id").select("query_id", F.col("id").alias(key), "similarity", F.round(weights[1] * v, DIGITS).alias("alone"))
    near = _best(alone, "alone", key, k)
    low, high = (f(F.col("score")).over(Window.partitionBy("query_id")) for f in (F.min, F.max))
    words = keyword.select("query_id", key, F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)).alias("s"))
    vectors = sections.withColumnRenamed("id", key)
    own = words.select("query_id", key).join(vectors, key).join(queries, "query_id")
    own = own.select("query_id", key, F.round(F.array_max(F.transform("vectors", lambda x: V.cosine(x, F.col("vector")))), 6).alias("similarity"))
    both = near.select("query_id", key, "similarity").unionByName(own).groupBy("query_id", key).agg(F.max("similarity").alias("similarity"))
    mixed = words.join(both, ["query_id", key], "full").join(extremes, "query_id", "left")
    s = F.coalesce("s", F.lit(0.0))
    scored = mixed.select("query_id", key, F.round(F.when(F.col("high").isNull(), s).otherwise(weights[0] * s + weights[1] * v), DIGITS).alias("score"))
    return _best(scored, "score", key, k)


def hybrid_left(keyword: DataFrame, queries: DataFrame, sections: DataFrame, key: str = "doc_id", weights: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """(query_id, key, score): the variant that keeps only keyword hits and scales nothing."""
    met = keyword.join(sections.withColumnRenamed("id", key), key, "left").join(queries, "query_id", "left")
    near = F.round(F.array_max(F.transform("vectors", lambda x: V.cosine(x, F.col("vector")))), 6)
    return met.select("query_id", key, F.round(weights[0] * F.col("score") + weights[1] * F.coalesce(near, F.lit(0.0)), 4).alias("score"))


def snippet(text: Column, most: int = 300) -> Column:
    return F.left(text, F.lit(most))
