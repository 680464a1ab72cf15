"""Text expressions: normalisation, keys, set measures, confidence curves and costs. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that normalisation drops.
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall "
    "to of in for on with at by from as into about between through during before after above below "
    "and or but not no if then than so what which who whom this that these those it its my your his her our their how when where why"
).split()
ALPHANUMERIC = r"(?U)[^\w\s]"
#: Price per 1K tokens (input, output); the first prefix in this order counts.
GENERATION_COST = {
    "gpt-4o": (0.0025, 0.01),
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-4": (0.03, 0.06),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "claude-3-opus": (0.015, 0.075),
    "claude-3-5-sonnet": (0.003, 0.015),
    "claude-3-haiku": (0.00025, 0.00125),
    "claude-opus-4": (0.015, 0.075),
    "claude-sonnet-4": (0.003, 0.015),
    "gemini-2.5-pro": (0.00125, 0.01),
    "gemini-2.0-flash": (0.0001, 0.001),
    "gemini-1.5-pro": (0.00125, 0.007),
}


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation and stop words, in order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), ALPHANUMERIC, " ")), r"(?U)\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS))


def normalize(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def normalize_fuzzy(text: Column) -> Column:
    """As normalize, words sorted."""
    return F.array_join(F.array_sort(tokens(text)), " ")


def present(value: Column) -> Column:
    """Whether a filter value counts: not null, empty, 0 or false."""
    return value.isNotNull() & ~F.lower(value.cast("string")).isin("", "0", "0.0", "false")


def answer_key(text: Column, filters: dict[str, Column] | None = None, temporal: Column | None = None, language: Column | None = None, namespace: Column | None = None, project: Column | None = None) -> Column:
    """SHA-256 of the normalised question and of all that scopes it; filters in order of their names."""
    parts = [normalize(text)]
    for name in sorted(filters or {}):
        parts.append(F.when(present(filters[name]), F.concat(F.lit(f"{name}:"), filters[name].cast("string"))))
    for prefix, value in (("temporal:", temporal), ("lang:", language), ("ns:", namespace), ("proj:", project)):
        if value is not None:
            given = present(value) & (value != "en") if prefix == "lang:" else present(value)
            parts.append(F.when(given, F.concat(F.lit(prefix), value.cast("string"))))
    return F.sha2(F.concat_ws("|", *parts), 256)


def scoped_key(text: Column, filters: Column) -> Column:
    """As answer_key, of filters in a map: those present, in order of their names."""
    given = F.filter(F.array_sort(F.map_entries(filters)), lambda e: present(e["value"]))
    listed = F.transform(given, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.sha2(F.concat_ws("|", normalize(text), F.when(F.size(listed) > 0, F.array_join(listed, "|"))), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays, as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def fuzzy_similarity(query: Column, stored: Column) -> Column:
    """0.6 of the token measures (0.4 Jaccard, 0.6 overlap) and 0.4 of the edit similarity of two normalised texts."""
    a, b = (F.array_distinct(F.filter(F.split(x, " "), lambda w: w != "")) for x in (query, stored))
    return 0.6 * (0.4 * jaccard(a, b) + 0.6 * overlap(a, b)) + 0.4 * levenshtein_similarity(query, stored)


#: The points of both curves stand in their functions.
def semantic_confidence(s: Column) -> Column:
    return (
        F.when(s >= 0.98, 0.99)
        .when(s >= 0.92, 0.85 + (s - 0.92) * 1.5)
        .when(s >= 0.85, 0.55 + (s - 0.85) * 4.3)
        .when(s >= 0.75, 0.25 + (s - 0.75) * 3.0)
        .otherwise(0.0)
    )


def fuzzy_confidence(s: Column) -> Column:
    return F.when(s >= 0.95, 0.80).when(s >= 0.90, 0.50 + (s - 0.90) * 4.0).when(s >= 0.85, 0.30 + (s - 0.85) * 4.0).otherwise(0.15)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def block_tokens(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * F.lit(1.3))).cast("long")


def quarter_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def generation_cost(model: Column, answer: Column, question: Column | None = None) -> Column:
    """US dollars, six decimals; unknown models cost nothing."""
    out = F.length(answer) / 4.0
    given = F.length(question) / 4.0 if question is not None else F.lit(0.0)
    cost = F.lit(0.0)
    for prefix, (of_input, of_output) in reversed(GENERATION_COST.items()):
        cost = F.when(F.lower(model).startswith(prefix), (given * of_input + out * of_output) / 1000.0).otherwise(cost)
    return F.floor(cost * 1e6 + 0.5) / 1e6


def mask_secret(value: Column, shown: int = 4) -> Column:
    """The first characters, and stars for the rest."""
    return F.concat(F.left(value, F.lit(shown)), F.repeat(F.lit("*"), F.greatest(F.length(value) - shown, F.lit(0))))


def truncate_to_tokens(text: Column, most: int, suffix: str = "\n... (truncated)") -> Column:
    return F.when(F.length(text) <= 4 * most, text).otherwise(F.concat(F.substring(text, 1, 4 * most), F.lit(suffix)))
