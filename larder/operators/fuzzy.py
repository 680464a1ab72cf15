"""Joins by likeness of texts: candidates by equi-joins on ids, bounds that rule pairs out, edits counted in a band at last.

No shuffle on grams or segments carries a text. Grams are taken of the distinct words that occur, never of whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.session import spread
from larder.storage import spill


def _grams(word: Column, n: int) -> Column:
    """All runs of n characters."""
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def holding(words: DataFrame, stored: DataFrame) -> DataFrame:
    """(word, cache_id): which records of stored(cache_id, question_normalized) hold a word, anywhere in their text.

    words(word): without spaces, so that a text holds one only within what stands between two spaces. These pieces are the
    vocabulary: a word meets those that hold its middle three letters, or, if it is shorter, those that hold all of it; then
    the records meet the vocabulary.
    """
    pieces = stored.select("cache_id", F.explode(F.array_distinct(F.split("question_normalized", " ", -1))).alias("piece")).where("piece <> ''")
    vocabulary, spelt = pieces.select("piece").distinct(), None
    for n, some in ((1, F.length("word") == 1), (2, F.length("word") == 2), (3, F.length("word") >= 3)):
        asked = words.where(some).select("word", F.substring(F.col("word"), F.floor((F.length("word") - n) / 2).cast("int") + 1, F.lit(n)).alias("gram"))
        met = vocabulary.select("piece", F.explode(F.array_distinct(_grams(F.col("piece"), n))).alias("gram")).join(asked, "gram").where(F.contains("piece", "word")).select("word", "piece")
        spelt = met if spelt is None else spelt.unionByName(met)
    return pieces.join(spelt, "piece").select("word", "cache_id").distinct()


def matches(asks: DataFrame, cache: DataFrame, k: int = 3, threshold: float = 0.3) -> DataFrame:
    """(question_id, cache_id, similarity, rank): the k records nearest to each question of asks(question_id, question).

    cache(cache_id, question_normalized). Candidates hold the question's two longest words (of equal length the smaller
    word) anywhere in their text; a question with no such candidate takes those that hold the longest. The similarity is of
    word sets and of edits, the question's words sorted. A pair's words bound it from below, words and lengths from above:
    who stays under what k others reach is out, and edits are counted only as far as they leave a chance. Nulls match nothing. A question without words has
    no row. Repeated rows are matched each. An empty table of either kind gives none. Runs jobs while it is built.
    """
    words = T.tokens(F.col("question"))
    ranked = F.array_sort(F.array_distinct(words), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    asked = asks.select("question_id", F.array_join(F.array_sort(words), " ").alias("query"), F.array_distinct(words).alias("words"), ranked.alias("w")).where(F.size("w") > 0)
    asked = spill(asked.select("question_id", "query", "words", F.get("w", F.lit(0)).alias("first"), F.coalesce(F.get("w", F.lit(1)), F.get("w", F.lit(0))).alias("second")))
    cache = spill(spread(cache.select("cache_id", "question_normalized").where("question_normalized is not null")))
    held = holding(asked.select(F.explode(F.array("first", "second")).alias("word")).distinct(), cache)
    met = asked.select("question_id", "first", "second").join(held.withColumnRenamed("word", "first"), "first")
    met = met.join(held.select(F.col("word").alias("second"), "cache_id", F.lit(True).alias("both")), ["second", "cache_id"], "left").select("question_id", "cache_id", F.coalesce("both", F.lit(False)).alias("both"))
    any_both = met.groupBy("question_id").agg(F.bool_or("both").alias("any_both"))
    pairs = met.join(any_both, "question_id").where("both or not any_both").select("question_id", "cache_id")

    # Bounds need sets of words and lengths only: words as numbers, so that a pair is small.
    numbers = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    stored = cache.select("cache_id", numbers(F.array_distinct(F.split("question_normalized", " ", -1))).alias("b"), F.length("question_normalized").alias("m"))
    sized = pairs.join(asked.select("question_id", numbers("words").alias("a"), F.length("query").alias("n")), "question_id").join(stored, "cache_id")
    shared, longest = F.size(F.array_intersect("a", "b")), F.greatest("n", "m")
    sets = 0.6 * (0.4 * shared / (F.size("a") + F.size("b") - shared) + 0.6 * shared / F.least(F.size("a"), F.size("b")))
    bound = sets + 0.4 * (1 - F.abs(F.col("n") - F.col("m")) / longest)
    bounded = sized.select("question_id", "cache_id", sets.alias("sets"), bound.alias("bound"), longest.alias("longest")).where(F.col("bound") >= threshold - 1e-6)
    # The k-th best similarity of words alone is one that k records reach.
    best = Window.partitionBy("question_id").orderBy(F.desc("sets"))
    bar = bounded.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("question_id", F.col("sets").alias("bar"))
    least = F.greatest(F.lit(float(threshold)), F.coalesce("bar", F.lit(0.0)))
    near = bounded.join(bar, "question_id", "left").withColumn("least", least).where(F.col("bound") >= F.col("least") - 1e-6)
    scored = _scored(near, asked, cache).where(F.col("similarity") >= threshold)
    order = Window.partitionBy("question_id").orderBy(F.desc("similarity"), "cache_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(pairs: DataFrame, asked: DataFrame, cache: DataFrame) -> DataFrame:
    """(question_id, cache_id, similarity) of pairs(question_id, cache_id, sets, longest, least), if it may reach least."""
    texts = pairs.join(asked.select("question_id", "query"), "question_id").join(cache.select("cache_id", "question_normalized"), "cache_id")
    edits = F.floor((1 - (F.col("least") - 1e-6 - F.col("sets")) / 0.4) * F.col("longest") + 1e-6)
    allowed = texts.withColumn("allowed", F.greatest(F.lit(0), F.least(F.col("longest"), edits)).cast("int"))
    near = allowed.where(F.expr("levenshtein(query, question_normalized, allowed) >= 0"))
    return near.select("question_id", "cache_id", F.round(T.fuzzy_similarity(F.col("query"), F.col("question_normalized")), 6).alias("similarity"))


def _segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """(start, length) of the edits + 1 segments of a text of some length, as even as can be, the last ones longer."""
    parts = edits + 1
    short, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    out = []
    for i in range(parts):
        before = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - longer))  # longer segments among those before
        out.append((short * i + before, short + (F.lit(i) >= F.lit(parts) - longer).cast("int")))
    return out


def within_edits(left: DataFrame, right: DataFrame, edits: int) -> DataFrame:
    """(left_id, right_id, edits): all pairs of left(left_id, text) and right(right_id, text) at most so many edits apart.

    A text of the right side is cut into edits + 1 segments. One of them must stand in the left text unchanged, at most
    `edits` places off; if it is the i-th, at most i edits can have gone before it and edits - i come after, so few starts
    are left to try. Segments meet as hashes with their number and the text's length. Texts are attached to pairs of
    distinct texts that met, and edits are counted in a band. Nulls match nothing; empty texts do, as texts of no length.
    Repeated rows match each. An empty table of either kind gives none. Characters are code points.
    """
    one = left.where("text is not null").groupBy("text").agg(F.collect_list("left_id").alias("left_ids")).withColumn("l", F.xxhash64("text"))
    two = right.where("text is not null").groupBy("text").agg(F.collect_list("right_id").alias("right_ids")).withColumn("r", F.xxhash64("text"))
    n = F.length("text")
    name = lambda size, i, piece: F.xxhash64(size, F.lit(i), piece)
    cut = [name(n, i, F.substring(F.col("text"), start + 1, size)) for i, (start, size) in enumerate(_segments(n, edits))]
    kept = two.select("r", F.explode(F.array_distinct(F.array(*cut))).alias("segment"))
    tries = []
    for off in range(-edits, edits + 1):  # the right text's length less the left one's
        size = n + off
        for i, (start, width) in enumerate(_segments(size, edits)):
            for shift in range(-edits, edits + 1):
                if abs(shift) <= i and abs(off - shift) <= edits - i:
                    at = start - F.lit(shift)
                    fits = (size >= 0) & (at >= 0) & (at + width <= n)
                    tries.append(F.when(fits, name(size, i, F.substring(F.col("text"), at + 1, width))))
    probes = one.select("l", F.explode(F.array_distinct(F.filter(F.array(*tries), lambda x: x.isNotNull()))).alias("segment"))
    met = probes.join(kept, "segment").select("l", "r").distinct()
    pairs = met.join(one.withColumnRenamed("text", "a"), "l").join(two.withColumnRenamed("text", "b"), "r")
    pairs = pairs.withColumn("edits", F.levenshtein("a", "b", edits)).where("edits >= 0")
    return pairs.select(F.explode("left_ids").alias("left_id"), "right_ids", "edits").select("left_id", F.explode("right_ids").alias("right_id"), "edits")
