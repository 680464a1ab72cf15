"""A written index of postings in order of impact, and top-k search over it that rules documents out before it scores them.

A posting's impact is what its term adds to a BM25 score before the term's rarity is counted in. Postings are written in
ranges of terms, each term's in blocks of falling impact; a block has one level, which bounds its impacts. Beside them is one
row per term, with the number of its documents and its greatest weight.

Search is MaxScore in relations: the best documents of a query's weightiest terms give a threshold; terms whose greatest
weights together stay under it can't bring a document in by themselves, so candidates come from the other terms' postings
only, less the blocks that can't reach the threshold. Candidates that can still reach it are scored in full.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.functions.counts import counted
from larder.session import spread
from larder.storage import spill

K1, B = 1.2, 0.75
#: Levels for each unit of impact; an impact is under K1 + 1.
LEVELS = 16
#: Weightiest terms of a query whose documents give the first threshold.
FIRST = 3
#: What rounding may take from a score.
SLACK = 2e-6


class Index(NamedTuple):
    postings: DataFrame  # term, level, key, impact
    terms: DataFrame  # term, df, idf, most
    documents: DataFrame  # n, mean


def impact_of(tf: Column, doc_length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_length / mean))


def idf_of(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_length, term, tf, at): one row per distinct term of a row of docs, and the place where it first stands. Keys are unique."""
    words = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", T.tokens(F.col("text")).alias("words"))
    # Counted within the text: rows of words, met by key and word, would all be shuffled for it.
    return _listed(counted(words.select("key", F.size("words").alias("doc_length"), "words")))


def _listed(texts: DataFrame) -> DataFrame:
    # With a null where there are no words, which a filter on the counts would find first.
    rows = texts.select("key", "doc_length", F.posexplode_outer("counts").alias("nth", "c")).where("c is not null")
    return rows.select("key", "doc_length", "c.term", "c.tf", "c.at")


def field_counts(docs: DataFrame, fields: dict[str, float], key: str = "doc_id") -> DataFrame:
    """As term_counts over several text columns: a word counts its column's weight each time it stands there, in tf and in doc_length."""

    def total(values) -> Column:
        return F.aggregate(F.array(*values), F.lit(0.0), lambda a, x: a + x)

    lists = F.array(*(T.tokens(F.coalesce(F.col(c), F.lit(""))) for c in fields)).alias("lists")
    words = spread(docs.select(F.col(key).alias("key"), F.struct(*fields).alias("f"))).select("key", "f.*").select("key", lists)
    # A word's place says which column it comes from, so that no weights are listed beside the words.
    sizes = [F.size(F.col("lists")[i]) for i in range(len(fields))]
    length = total(n * F.lit(float(w)) for n, w in zip(sizes, fields.values(), strict=True))
    ends = [sum(sizes[1 : i + 1], sizes[0]) for i in range(len(fields))]
    listed = words.select("key", length.alias("doc_length"), F.array(*ends).alias("ends"), F.flatten("lists").alias("words"))
    return _listed(counted(listed, [float(w) for w in fields.values()]))


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", fields: dict[str, float] | None = None) -> Index:
    """The index of docs(key, text), written to the shared folder. Keys are unique; null texts and those without words have no postings.

    fields: text columns and their positive weights, instead of the one text.
    """
    counts = spill(field_counts(docs, fields, key) if fields else term_counts(docs, key, text))
    documents = spill(counts.agg(F.count_if(F.col("at") == 0).alias("n"), (F.sum("tf") / F.count_if(F.col("at") == 0)).alias("mean")))
    scored = counts.crossJoin(F.broadcast(documents)).select("term", "key", impact_of(F.col("tf"), F.col("doc_length"), F.col("mean")).alias("impact"))  # one row
    leveled = scored.withColumn("level", F.ceil(F.col("impact") * LEVELS).cast("int"))
    by = [F.col("term"), F.col("level").desc()]
    postings = spill(leveled.repartitionByRange(*by).sortWithinPartitions(*by).select("term", "level", "key", "impact"))
    sums = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top")).crossJoin(F.broadcast(documents))  # one row
    idf = idf_of(F.col("df"), F.col("n"))
    return Index(postings, spill(sums.select("term", "df", idf.alias("idf"), (idf * F.col("top")).alias("most"))), documents)


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, terms, term, df, idf, most, above, all): a query's terms that occur; above: what those of less weight add up to at most."""
    listed = queries.select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("t")).select("query_id", F.size("t").alias("terms"), F.explode("t").alias("term"))
    found = listed.join(index.terms, "term")
    lighter = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "term"))
    whole = Window.partitionBy("query_id")
    return found.select("query_id", "terms", "term", "df", "idf", "most", F.sum("most").over(lighter).alias("upto"), F.sum("most").over(whole).alias("all"), place.alias("place"))


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bar(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, bar): what the k-th best document has at least, of scores that aren't too high; null if there are fewer."""
    return _ranked(scored.select("query_id", "key", "score"), k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") - SLACK).alias("bar"))


def top(index: Index, queries: DataFrame, k: int = 10, scope: DataFrame | None = None, key: str = "doc_id", counted: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the k best documents for each of queries(query_id, text) by BM25, equal to scoring all.

    scope(key): only these documents are found; weights stay those of all. Queries with null text or without a known word
    find nothing. Ties go to the smaller key. With counted, one row (met, scored) instead: pairs of a query and a document
    that share a word, and those of them that were scored in full. Runs jobs while it is built.
    """
    asked = spill(_asked(index, queries))
    wanted = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    if scope is not None:
        wanted = wanted.join(scope.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    wanted = spill(wanted)
    weight = F.col("idf") * F.col("impact")
    first = wanted.join(asked.where(F.col("place") <= FIRST), "term").groupBy("query_id", "key").agg(F.sum(weight).alias("score"))
    seeds = _ranked(first, k).select("query_id", "key").join(asked.select("query_id", "term", "idf"), "query_id").join(wanted, ["term", "key"])
    barred = spill(asked.join(_bar(seeds.groupBy("query_id", "key").agg(F.sum(weight).alias("score")), k), "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0))))
    essential = barred.where(F.col("upto") >= F.col("bar"))
    spare = barred.where(F.col("upto") < F.col("bar"))
    reach = F.col("idf") * F.col("level") / LEVELS + F.col("all") - F.col("most")
    met = wanted.join(essential, "term").where(reach >= F.col("bar")).groupBy("query_id", "key").agg(F.sum(weight).alias("part"), F.first("bar").alias("bar"))
    light = spare.groupBy("query_id").agg(F.max("upto").alias("light"))
    met = spill(met)
    higher = _bar(met.withColumnRenamed("part", "score"), k).withColumnRenamed("bar", "higher")
    near = met.join(light, "query_id", "left").join(higher, "query_id", "left")
    near = near.where(F.col("part") + F.coalesce("light", F.lit(0.0)) >= F.greatest("bar", F.coalesce("higher", F.lit(0.0))))
    candidates = spill(near.select("query_id", "key", "part"))
    others = candidates.join(spare.select("query_id", "term", "idf"), "query_id").join(wanted, ["term", "key"])
    added = others.groupBy("query_id", "key").agg(F.sum(weight).alias("more"))
    scored = candidates.join(added, ["query_id", "key"], "left").select("query_id", "key", F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))
    if counted:
        every = wanted.join(asked, "term").select("query_id", "key").distinct().agg(F.count("*").alias("met"))
        return every.crossJoin(candidates.agg(F.count("*").alias("scored")))  # one row each
    return _ranked(scored, k).withColumnRenamed("key", key)


def with_every_term(index: Index, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score): all documents that hold all terms of a query.

    They are among those of its rarest term, and the other terms' postings are met with these alone.
    """
    asked = _asked(index, queries)
    known = asked.groupBy("query_id").agg(F.count("*").alias("known"), F.first("terms").alias("terms"), F.min(F.struct("df", "term")).alias("rare")).where("known = terms")
    complete = spill(known.select("query_id", "terms", F.col("rare.term").alias("rarest")).join(asked.select("query_id", "term", "idf"), "query_id"))
    wanted = spill(index.postings.join(complete.select("term").distinct(), "term", "left_semi"))
    candidates = wanted.join(complete.where("term = rarest").select("query_id", "term"), "term").select("query_id", "key")
    met = candidates.join(complete, "query_id").join(wanted, ["term", "key"])
    sums = met.groupBy("query_id", "key").agg(F.sum(F.col("idf") * F.col("impact")).alias("score"), F.count("*").alias("met"), F.first("terms").alias("terms"))
    return sums.where("met = terms").select("query_id", F.col("key").alias(key), F.round("score", 6).alias("score"))


def _spaced(words: Column) -> Column:
    """Words with two spaces between and one around, so that phrases side by side each have their own."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def phrases(index: Index, docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, tf, doc_length): documents that hold all words of a query, without stop words, in a row, and how often.

    Candidates hold every term; only their texts are looked at.
    """
    asked = queries.select("query_id", T.tokens(F.col("text")).alias("w")).where(F.size("w") > 0).select("query_id", _spaced(F.col("w")).alias("phrase"))
    candidates = with_every_term(index, queries, key).select("query_id", key).join(asked, "query_id")
    met = candidates.join(docs.select(key, T.tokens(F.col(text)).alias("w")), key).select("query_id", key, "phrase", _spaced(F.col("w")).alias("body"), F.size("w").alias("doc_length"))
    times = (F.length("body") - F.length(F.replace("body", F.col("phrase"), F.lit("")))) / F.length("phrase")
    return met.where(F.contains("body", F.col("phrase"))).select("query_id", key, times.cast("long").alias("tf"), "doc_length")


def phrase_top(index: Index, docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k: int = 10) -> DataFrame:
    """(query_id, key, score, rank): a phrase is one term, whose frequency is that of documents that hold it."""
    found = spill(phrases(index, docs, queries, key, text))
    df = found.groupBy("query_id").agg(F.count("*").alias("df"))
    scored = found.join(df, "query_id").crossJoin(F.broadcast(index.documents))  # one row
    score = idf_of(F.col("df"), F.col("n")) * impact_of(F.col("tf"), F.col("doc_length"), F.col("mean"))
    return _ranked(scored.select("query_id", F.col(key).alias("key"), F.round(score, 6).alias("score")), k).withColumnRenamed("key", key)
