"""Evidence: rows (question_id, layer, ord, confidence, text, is_partial) combined into one confidence and decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import clamp

SERVE = 0.95
#: What a layer's evidence weighs.
EXACT, COMPOSABLE, FUZZY, SESSION, DEMOTION = 1.0, 0.85, 0.40, 0.25, -0.5


def link_confidence(similarity: Column, strength: Column) -> Column:
    return similarity * 0.5 + F.least(strength * 0.05, F.lit(0.25))


def accumulate(evidence: DataFrame) -> DataFrame:
    """(question_id, confidence, n): one minus the product of the doubts, less all negative confidences, in [0, 1].

    The product is taken in order of (ord, layer), so that the result doesn't depend on how rows arrive.
    """
    listed = evidence.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("ord", "layer", "confidence"))).alias("e"))
    doubt = F.aggregate("e", F.lit(1.0), lambda a, x: F.when(x["confidence"] > 0, a * (1 - x["confidence"])).otherwise(a))
    minus = F.aggregate("e", F.lit(0.0), lambda a, x: F.when(x["confidence"] < 0, a - x["confidence"]).otherwise(a))
    return listed.select("question_id", clamp(1 - doubt - minus).alias("confidence"), F.size("e").cast("long").alias("n"))


def best_answer(evidence: DataFrame) -> DataFrame:
    """(question_id, layer, ord, confidence): the most confident whole answer; of equal ones the first."""
    order = F.struct(F.col("confidence"), -F.col("ord"))
    return evidence.where("not is_partial").groupBy("question_id").agg(F.max_by(F.struct("layer", "ord", "confidence"), order).alias("b")).select("question_id", "b.*")


def context(evidence: DataFrame) -> DataFrame:
    """(question_id, context): the texts by falling confidence, each under its layer and confidence, and the sub-question it answers, if evidence has such a column."""
    about = F.when(F.coalesce(F.col("sub_query"), F.lit("")) != "", F.concat(F.lit(" (re: "), "sub_query", F.lit(")"))).otherwise("") if "sub_query" in evidence.columns else F.lit("")
    line = F.struct((-F.col("confidence")).alias("c"), "ord", F.concat(F.lit("["), "layer", F.lit(":"), F.format_number("confidence", 2), F.lit("]"), about, F.lit("\n"), "text").alias("t"))
    listed = evidence.where("text <> ''").groupBy("question_id").agg(F.sort_array(F.collect_list(line)).alias("e"))
    return listed.select("question_id", F.array_join(F.transform("e", lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def decide(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, confidence, decision): serve at 0.95 with a whole answer; any evidence gives context; none, none."""
    rows = questions.select("question_id").join(accumulate(evidence), "question_id", "left").join(best_answer(evidence).select("question_id", F.lit(True).alias("whole")), "question_id", "left")
    decision = F.when((F.col("confidence") >= SERVE) & F.col("whole"), "SERVE").when(F.col("n") > 0, "GENERATE_WITH_CONTEXT").otherwise("GENERATE")
    return rows.select("question_id", F.round(F.coalesce("confidence", F.lit(0.0)), 6).alias("confidence"), decision.alias("decision"))


def first_hit(evidence: DataFrame, questions: DataFrame, order: list[str], thresholds: dict[str, float]) -> DataFrame:
    """(question_id, layer): the first layer in order with evidence that reaches its threshold; null if none does."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("layer"))
    bar = F.lit(2.0)
    for layer, least in thresholds.items():
        bar = F.when(F.col("layer") == layer, least).otherwise(bar)
    served = evidence.where(F.col("confidence") >= bar).groupBy("question_id").agg(F.min_by("layer", place).alias("layer"))
    return questions.select("question_id").join(served, "question_id", "left")


def two_hops(links: DataFrame, starts: DataFrame, per_hop: tuple[int, int] = (3, 2), most: int = 10) -> DataFrame:
    """(start, target, hop, confidence) over links(source, target, similarity, strength).

    Hop one goes both ways, so many links each way, hop two only forward; a target is taken once, by its nearer hop, and
    by `most` in all. Reached nodes are ranked by hop, falling confidence and id.
    """
    def top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("similarity"), "target")
        return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")

    cols = ["source", "target", "similarity", "strength"]
    forward = top(links.select(*cols), ["source"], per_hop[0])
    reverse = top(links.select(F.col("target").alias("source"), F.col("source").alias("target"), "similarity", "strength"), ["source"], per_hop[0])
    first = starts.select(F.col("id").alias("source")).join(forward.unionByName(reverse), "source").select(F.col("source").alias("start"), "target", "similarity", "strength")
    first = first.where("target <> start")
    second = first.select("start", F.col("target").alias("source")).distinct().join(top(links.select(*cols), ["source"], per_hop[1]), "source")
    second = second.where("target <> start").select("start", "target", F.lit(2).alias("hop"), (F.col("similarity") * 0.15).alias("confidence"))
    found = first.select("start", "target", F.lit(1).alias("hop"), link_confidence(F.col("similarity"), F.col("strength")).alias("confidence")).unionByName(second)
    once = found.groupBy("start", "target").agg(F.min(F.struct("hop", (-F.col("confidence")).alias("c"))).alias("m")).select("start", "target", "m.hop", (-F.col("m.c")).alias("confidence"))
    order = Window.partitionBy("start").orderBy("hop", F.desc(F.round("confidence", 7)), "target")
    return once.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def newest_valid(answers: DataFrame, most: int) -> DataFrame:
    """The valid ones of answers(cache_id, created_s, is_valid, ...), at most so many, newest first, of one time the smaller id."""
    return answers.where("is_valid").orderBy(F.desc("created_s"), "cache_id").limit(most)
