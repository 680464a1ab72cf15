"""Quality rules: counts of words, symbols, repeated lines and repeated windows, and how far a document's histograms of
character classes and common words diverge from those of its language. JVM expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cleared, spill

#: Frequent function words of each language, one bin of the histogram each.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was with as be by are this at from he not or an but his have which they had her has were she their been will if more when who one all there".split(),
    "de": "der die und in den von zu das mit sich des ist für auf nicht im dem ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum".split(),
    "fr": "de la le et les des en un du une que est pour par qui dans sur pas avec au il ne se plus ce son sont ou mais aux a sa cette ont ses nous elle être fait comme tout leur".split(),
    "es": "de la que el en y a los se del las un por con su no una para es al lo como más pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue".split(),
}
WHITE = " \t\n\x0b\x0c\r"
#: Marks that may stand around a word.
POINTS = ".,;:\"()"
WINDOW = 8
#: Documents of fewer words aren't held to the histograms: to that of characters, to that of common words.
LEAST_WORDS = (20, 60)
#: Jensen-Shannon distances (base 2, from 0 to 1) above which a document is rejected.
MOST_DISTANCE = (0.30, 0.22)
#: A sample of n words from a histogram of k bins lies off it by about k / (NOISE * n) in squared distance; this
#: isn't held against a document.
NOISE = 8


def let(value: Column, body) -> Column:
    """body(value) where value is computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of eight words whose sequence occurs twice or more in the array.

    Windows are compared by 64-bit hashes. Only arrays with an equal pair are sorted.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) & (k > 0) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(counted).cast("bigint")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def features(docs: DataFrame, columns: list[str], common: dict[str, list[str]]) -> DataFrame:
    """row (a struct of the columns), the counts, and chars and commons: the two histograms as arrays of counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bins = sorted({w for listed in common.values() for w in listed})
    plain = F.split(F.lower(F.translate(F.col("text"), POINTS, " " * len(POINTS))), r"[\x20\x09-\x0D]+")
    known = F.filter(plain, lambda w: w.isin(bins))
    language = F.when(F.col("lang").isin(list(common)), F.col("lang")).otherwise("")
    listed = F.lit(None).cast("array<string>")
    for name, own in common.items():
        listed = F.when(F.col("language") == name, F.array(*map(F.lit, own))).otherwise(listed)
    listed = F.coalesce(listed, F.array(*map(F.lit, bins)))
    out = docs.select(F.struct(*columns).alias("row"), language.alias("language"), text.alias("text"), words.alias("words"))
    out = out.select(
        "row",
        "language",
        F.length("text").alias("n_all"),
        F.size("words").cast("bigint").alias("n_words"),
        _without(F.col("text"), WHITE).cast("bigint").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), "#*$%&|<>")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("n_upper"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{N}+", ""))).alias("n_digit"),
        (F.length("text") - _without(F.col("text"), "!?")).alias("n_shout"),
        (F.length("text") - _without(F.col("text"), POINTS + "'-")).alias("n_point"),
        let(known, lambda found: F.transform(listed, lambda c: F.size(found) - F.size(F.array_remove(found, c)))).alias("commons"),
    )
    parts = [F.col("n_all") - F.col("word_chars"), *map(F.col, ("n_symbols", "n_upper", "n_digit", "n_shout", "n_point"))]
    rest = F.col("word_chars") - sum(parts[2:], F.col("n_symbols"))
    chars = F.array(*(x.cast("double") for x in (*parts, F.greatest(rest, F.lit(0)))))
    other = F.greatest(F.col("n_words") - F.aggregate("commons", F.lit(0), lambda a, x: a + x), F.lit(0))
    commons = F.concat(F.transform("commons", lambda x: x.cast("double")), F.array(other.cast("double")))
    return out.select("row", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("chars"), commons.alias("commons"))


def shares(counts: Column) -> Column:
    """Counts over their sum; all zero if there are none."""
    return let(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))))


def divergence(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares: the root of the divergence, base 2; 0 to 1."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, columns: list[str], common: dict[str, list[str]] | None = None) -> DataFrame:
    """(row, counts, base_failed, distances, kept) of every row of docs(text, lang); row holds the columns.

    The references are the summed histograms of all rows of a language that don't fail the base rules, with one for all
    rows of unknown or null languages; there are as many as languages in `common`, plus one. Null and empty texts have no
    words and fail. Documents under LEAST_WORDS aren't held to that histogram; nor are those whose language has no
    reference. Repeated rows are judged alike. The columns may have any names. An empty table gives none. A very long text is
    one row's arrays of words and windows, some 100 bytes a word. Runs a job while it is built.
    """
    found = spill(features(docs, columns, common or COMMON_WORDS))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = found.where(~failed & (F.col("n_words") >= LEAST_WORDS[0]))

    def reference(name: str) -> DataFrame:
        sums = good.select("language", F.posexplode(name).alias("i", "x")).groupBy("language", "i").agg(F.sum("x").alias("x"))
        listed = sums.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
        return listed.select(F.col("language").alias(f"of_{name}"), shares(F.transform("s", lambda x: x["x"])).alias(f"ref_{name}"))

    for name in ("chars", "commons"):  # a row for each language of `common` and one more: safe to broadcast
        ref = F.broadcast(reference(name))
        found = found.join(ref, F.col("language") == F.col(f"of_{name}"), "left").drop(f"of_{name}")
    found = found.withColumn("char_distance", divergence(shares(F.col("chars")), F.col("ref_chars")))
    found = found.withColumn("word_distance", divergence(shares(F.col("commons")), F.col("ref_commons")))
    noise = F.size("commons") / (NOISE * F.col("n_words"))
    off = {"char_distance": F.col("char_distance"), "word_distance": F.sqrt(F.greatest(F.pow("word_distance", 2) - noise, F.lit(0.0)))}
    far = F.lit(False)
    for name, least, most in zip(off, LEAST_WORDS, MOST_DISTANCE, strict=True):
        far = far | ((F.col("n_words") >= least) & (F.coalesce(off[name], F.lit(0.0)) > most))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far).drop("chars", "commons", "ref_chars", "ref_commons")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, ["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 4).alias("char_distance"), F.round("word_distance", 4).alias("word_distance"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that the rules keep, all columns as they are; null and empty texts go. See `judge`."""
    from .jaccard import only_rows
    from .simhash import numbered

    number = "larder_row"
    while number in docs.columns:
        number += "_"
    every = numbered(docs, number)
    with cleared(spark):  # counts are put aside with a row's number, not with its text
        kept = spill(judge(every, [number]).where("kept").select(F.col("row")[number].alias(number)), outer=True)
    return only_rows(every, kept, number).select(*(F.col(f"`{c}`") for c in docs.columns))
