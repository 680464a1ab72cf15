"""Rule extractors over text: headlines, structure, facts, domains, topics, tags and atomic facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.counts import counted
from larder.functions.text import block_tokens

#: Words of each domain, in order of precedence.
DOMAINS = {
    "legal": ["statute", "regulation", "law", "legal", "court", "judge", "plaintiff", "defendant", "jurisdiction", "ordinance", "code", "§"],
    "finance": ["financial", "banking", "investment", "securities", "stock", "bond", "revenue", "fiscal", "monetary", "tax", "interest rate"],
    "healthcare": ["medical", "health", "clinical", "patient", "hospital", "disease", "treatment", "pharmaceutical", "diagnosis", "therapy"],
    "technology": ["software", "hardware", "algorithm", "database", "network", "api", "cloud", "computing", "digital", "cyber", "protocol"],
    "government": ["government", "federal", "state", "municipal", "agency", "policy", "executive", "legislative", "congressional", "administrative"],
    "education": ["education", "school", "university", "curriculum", "academic", "student", "faculty", "research", "institution"],
    "environment": ["environment", "climate", "pollution", "emissions", "conservation", "ecological", "sustainability", "renewable"],
}
#: Words that are no topics.
TOPIC_STOPS = (
    "that this with from have been were will would could should shall which their there they than then also into some such each other more most only very "
    "when where what about after before between under over"
).split()
#: Patterns of entity kinds.
ENTITY_TYPES = {
    "statute": r"\d+\s+[A-Z][A-Za-z.]+\s+§",
    "regulation": r"(?i)(?:regulation|rule|directive|order)\s+\d+",
    "contract": r"(?i)(?:party|parties|agreement|contract|whereas|herein)",
    "citation": r"\d+\s+[A-Z][a-z]+\.?\s+\d+",
    "table": r"(?m)^\|.*\|.*\|",
    "list": r"(?m)^[\-\*•]\s+",
    "numbered_list": r"(?m)^\d+[.)]\s+",
}
#: Months, dates, and patterns of facts.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATES = rf"\b(?:\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}|(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})\b"
FACTS = {
    "dates": DATES,
    "amounts": r"(?i)\$[\d,]+(?:\.\d{2})?(?:\s*(?:million|billion|trillion))?",
    "percentages": r"\d+(?:\.\d+)?%",
    "citations": r"\d+\s+[A-Z][A-Za-z.]+\s+§\s*\d+",
    "codes": r"\b[A-Z]{2,}[-\d]+[A-Z\d]*\b",
    "proper_nouns": r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b",
}
#: Two letters that are no jurisdiction, and openings of sentences that state nothing.
NO_JURISDICTION = "IN IT IS AN AT AS IF OR ON NO SO TO UP DO GO AM BE BY HE WE".split()
FILLERS = "however|additionally|moreover|furthermore|in conclusion|to summarize|as mentioned|it is worth noting|please note|i hope this helps|let me know"
#: Categories of facts in order of precedence.
CATEGORIES = {
    "definition": r"\b(defined as|means|refers to|is a|is the)\b",
    "rule": r"\b(must|shall|required|prohibited|allowed)\b",
    "comparison": r"\b(compared to|unlike|whereas|while|differs)\b",
    "procedure": r"\b(step|first|then|next|finally|process)\b",
    "statistic": r"\b(\d+%|\$\d|million|billion|percent)\b",
}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value bound to a variable, so that it is found once however often it is used."""
    return F.transform(F.array(value), use)[0]


def lines(text: Column) -> Column:
    """The stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def headline(title: Column, text: Column) -> Column:
    """The title; else a first sentence of at most 200 characters; else 120 characters, cut at a word's end."""
    body = F.trim(text)
    sentence = F.trim(F.regexp_extract(body, r"^(.+?[.!?])\s", 1))
    head = F.left(body, F.lit(120))
    last_space = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", head) > 0) & (last_space > 40), F.substring(head, F.lit(1), last_space)).otherwise(head)
    return (
        F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.trim(title))
        .when((sentence != "") & (F.length(sentence) <= 200), sentence)
        .when(F.length(body) <= 120, body)
        .otherwise(F.concat(cut, F.lit("...")))
    )


#: How lines of each structure begin.
KEY_VALUE, BULLET, NUMBERED, LISTED = r"^[^:]{1,60}:\s+.+", r"^[\-\*•‣]\s+", r"^\d+[.)]\s+", r"^[\-\*•\d]+[.)]\s+|^[\-\*•]\s+"


def _at_least(found: Column, pattern: str, n: int) -> Column:
    return F.size(F.filter(found, lambda x: x.rlike(pattern))) >= n


def structured_type(text: Column) -> Column:
    found = lines(text)
    pipes = F.size(F.filter(found, lambda x: F.length(x) - F.length(F.translate(x, "|", "")) >= 2))
    return (
        F.when(F.trim(text) == "", "empty")
        .when(pipes >= 2, "table")
        .when(_at_least(found, KEY_VALUE, 2), "key_value")
        .when(_at_least(found, BULLET, 2), "bullet_list")
        .when(_at_least(found, NUMBERED, 2), "numbered_list")
        .otherwise("narrative")
    )


def structured(text: Column) -> Column:
    """struct(type, headers, rows, data, items, facts): what a text's structure holds; the members of other types are null.

    rows are the cells of each line of a table after the first. data maps keys to their last value, in order of the first.
    facts are sorted and distinct.
    """
    found, kind = lines(text), structured_type(text)
    cells = F.transform(
        F.filter(found, lambda x: F.length(x) - F.length(F.translate(x, "|", "")) >= 2),
        lambda x: F.filter(F.transform(F.split(x, r"\|", -1), lambda c: F.trim(c)), lambda c: (c != "") & ~c.rlike("^-+$")),
    )
    headers = F.get(cells, F.lit(0))
    rows = F.filter(F.slice(cells, 2, 1_000_000_000), lambda r: F.size(r) > 0)
    pairs = F.transform(F.filter(found, lambda x: x.rlike(KEY_VALUE)), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]{1,60}):\s+(.+)", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^([^:]{1,60}):\s+(.+)", 2)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    data = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))
    item = lambda x: F.regexp_replace(F.regexp_replace(x, BULLET, ""), NUMBERED, "")
    items = lambda begin: F.filter(F.transform(F.filter(found, lambda x: x.rlike(begin)), item), lambda x: x != "")
    narrative = F.map_filter(F.create_map(*(x for k in FACTS for x in (F.lit(k), facts(text, k)))), lambda _, v: F.size(v) > 0)
    return F.struct(
        kind.alias("type"),
        F.when(kind == "table", headers).alias("headers"),
        F.when(kind == "table", rows).alias("rows"),
        F.when(kind == "key_value", data).alias("data"),
        F.when(kind == "bullet_list", items(BULLET)).when(kind == "numbered_list", items(NUMBERED)).alias("items"),
        F.when(kind == "narrative", narrative).alias("facts"),
    )


def blocks(sections: DataFrame, key: str, title: Column, text: str = "text") -> DataFrame:
    """(key, compression, content, version_hash, token_count): the full text, its headline and its structure as JSON.

    The structure's token count is the source's.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    head = headline(title, body)
    made = F.array(
        F.struct(F.lit("full").alias("compression"), body.alias("content"), block_tokens(body).alias("token_count")),
        F.struct(F.lit("headline").alias("compression"), head.alias("content"), block_tokens(head).alias("token_count")),
        F.struct(F.lit("structured").alias("compression"), F.to_json(structured(body)).alias("content"), block_tokens(body).alias("token_count")),
    )
    return sections.select(key, F.sha2(body, 256).alias("version_hash"), F.explode(made).alias("b")).select(key, "b.compression", "b.content", "version_hash", "b.token_count")


def tags(sections: DataFrame, key: str, kind: Column, title: Column, hierarchy: Column, text: str = "text") -> DataFrame:
    """(key, tag_key, tag_value, confidence, source): domain, topics, entity types, entities, complexity and format hint.

    Topics are the title, the parts of the hierarchy path (joined by `/`) of over two characters, and frequent words. One row for
    each key, tag_key and value, the most confident.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    tag = lambda name, value, confidence, source="rule": F.struct(F.lit(name).alias("tag_key"), value.alias("tag_value"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"))
    named = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    parts = F.filter(F.transform(F.split(F.coalesce(hierarchy, F.lit("")), "/"), lambda p: F.lower(F.trim(p))), lambda p: F.length(p) > 2)
    # Columns of their own, as an expression within a list to explode is evaluated as often as it stands there.
    told = {"domain": domain(kind, title, body), "level": complexity(body), "format": format_of(body), "named": named, "parts": parts, "types": entity_types(body), "entities": entities(body)}
    d, level, hint = F.col("_domain"), F.col("_level"), F.col("_format")
    sure = F.when(level == "simple", 1.0).when(level == "medium", 0.8).otherwise(0.85)
    rows = F.concat(
        F.array(tag("domain", d["domain"], d["confidence"]), tag("complexity", level, sure), tag("format_hint", hint["hint"], hint["confidence"])),
        F.filter(F.array(tag("topic", F.col("_named"), F.lit(0.95))), lambda t: t["tag_value"] != ""),
        F.transform("_parts", lambda p: tag("topic", p, F.lit(0.8))),
        F.transform("_types", lambda t: tag("entity_type", t["type"], t["confidence"])),
        F.transform("_entities", lambda e: tag("entities", e["value"], e["confidence"], "ner")),
    )
    found = sections.select(key, *(c.alias(f"_{name}") for name, c in told.items())).select(key, F.explode(rows).alias("t")).select(key, "t.*")
    frequent = topics(sections, key, text).select(key, F.lit("topic").alias("tag_key"), F.col("topic").alias("tag_value"), "confidence", F.lit("rule").alias("source"))
    return found.unionByName(frequent).groupBy(key, "tag_key", "tag_value").agg(F.max(F.struct("confidence", "source")).alias("t")).select(key, "tag_key", "tag_value", "t.confidence", "t.source")


def facts(text: Column, kind: str) -> Column:
    """Sorted distinct matches; of proper nouns the first 20."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(FACTS[kind]), F.lit(0))))
    return F.slice(found, 1, 20) if kind == "proper_nouns" else found


def domain(document_type: Column, title: Column, text: Column) -> Column:
    """struct(domain, confidence): by the document's type; else the domain with most of its words in title and beginning."""
    scanned = F.lower(F.concat_ws(" ", title, F.lit(""), F.left(text, F.lit(500))))
    kind = F.lower(F.coalesce(document_type, F.lit("")))

    def best(found: Column) -> Column:
        hits = {name: sum((F.contains(found, F.lit(w)).cast("int") for w in words), F.lit(0)) for name, words in DOMAINS.items()}
        return F.array_max(F.array(*(F.struct(n.alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, n) in enumerate(hits.items()))))

    def told(top: Column) -> Column:
        out = F.when(top["hits"] >= 3, F.struct(top["name"].alias("domain"), F.lit(0.9).alias("confidence"))).when(top["hits"] >= 1, F.struct(top["name"].alias("domain"), F.lit(0.7).alias("confidence")))
        return out.otherwise(F.struct(F.lit("general").alias("domain"), F.lit(0.5).alias("confidence")))

    out = _once(_once(scanned, best), told)
    for name, words in reversed(DOMAINS.items()):
        out = F.when(kind.isin(words), F.struct(F.lit(name).alias("domain"), F.lit(0.95).alias("confidence"))).otherwise(out)
    return out


def topics(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, topic, n, confidence): the three most frequent plain words of four or more letters that occur twice. Keys are unique.

    Counted and ranked within the row, so that nothing is shuffled.
    """
    words = F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: w.rlike("^[a-z]{4,}$") & ~w.isin(TOPIC_STOPS))
    repeated = F.transform(F.filter("counts", lambda c: c["tf"] >= 2), lambda c: F.struct((-c["tf"]).alias("less"), c["at"].alias("at"), c["term"].alias("topic")))
    top = counted(rows.select(key, words.alias("words"))).select(key, F.explode_outer(F.slice(F.sort_array(repeated), 1, 3)).alias("t")).where("t is not null")
    n = -F.col("t.less")
    return top.select(key, "t.topic", n.alias("n"), F.round(F.least(F.lit(0.7), 0.3 + n * 0.1), 2).alias("confidence"))


def entity_types(text: Column) -> Column:
    """Array of struct(type, confidence)."""
    kinds = [F.struct(F.lit(k).alias("type"), F.regexp_count(text, F.lit(p)).alias("n")) for k, p in ENTITY_TYPES.items()]
    found = F.filter(F.array(*kinds), lambda x: x["n"] > 0)
    return F.transform(found, lambda x: F.struct(x["type"].alias("type"), F.round(F.least(F.lit(0.95), 0.6 + x["n"] * 0.1), 2).alias("confidence")))


def entities(text: Column) -> Column:
    """Array of struct(value, confidence), distinct values in order of kind and place, 30 at most."""
    def all_of(pattern: str, confidence: float, keep=None) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.struct((F.filter(values, keep) if keep else values).alias("values"), F.lit(confidence).alias("confidence"))

    kinds = F.array(
        all_of(FACTS["citations"], 0.95),
        all_of(DATES, 0.9),
        all_of(FACTS["amounts"], 0.9),
        all_of(FACTS["percentages"], 0.85),
        all_of(r"(?U)\b[A-Z]{2}\b", 0.6, lambda v: ~v.isin(NO_JURISDICTION)),
        all_of(r"(?<=\s)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", 0.7),
    )

    def added(found: Column, kind: Column) -> Column:
        new = F.array_except(kind["values"], F.transform(found, lambda x: x["value"]))
        return F.concat(found, F.transform(new, lambda v: F.struct(v.alias("value"), kind["confidence"].alias("confidence"))))

    # Kind by kind, as a look back from each match would find all matches of the text anew.
    return F.slice(F.aggregate(kinds, F.array().cast("array<struct<value:string,confidence:double>>"), added), 1, 30)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def complexity(text: Column) -> Column:
    def told(w: Column) -> Column:
        diversity = w["distinct"] / F.greatest(w["n"], F.lit(1))
        return F.when(w["n"] == 0, "simple").when((w["n"] > 500) & (diversity > 0.5), "high").when((w["n"] > 200) | (diversity > 0.6), "medium").otherwise("low")

    counts = _once(_words(F.lower(text)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    return _once(counts, told)


def format_of(text: Column) -> Column:
    """struct(hint, confidence): the first rule that holds, and how sure it is; of prose, by the words in a line."""
    def counts(found: Column) -> Column:
        of = lambda pattern: F.size(F.filter(found, lambda x: x.rlike(pattern)))
        pipes = F.size(F.filter(found, lambda x: F.length(x) - F.length(F.translate(x, "|", "")) >= 2))
        return F.struct(F.size(found).alias("n"), pipes.alias("pipes"), F.size(_words(text)).alias("words"), of("\t").alias("tabs"), of(LISTED).alias("listed"), of(KEY_VALUE).alias("pairs"))

    def told(c: Column) -> Column:
        rules = [(c["n"] == 0, "simple", 1.0), (c["pipes"] >= 2, "structured_data", 0.95), (c["tabs"] >= 2, "structured_data", 0.85), (c["listed"] >= 3, "list", 0.9), (c["pairs"] >= 2, "structured_data", 0.8)]
        rules += [(c["words"] < 30, "simple", 0.9), (c["words"] / F.greatest(c["n"], F.lit(1)) > 15, "narrative", 0.85)]
        return F.coalesce(*(F.when(holds, F.struct(F.lit(hint).alias("hint"), F.lit(sure).alias("confidence"))) for holds, hint, sure in rules), F.struct(F.lit("narrative").alias("hint"), F.lit(0.7).alias("confidence")))

    return _once(_once(lines(text), counts), told)


def format_hint(text: Column) -> Column:
    return format_of(text)["hint"]


def format_confidence(text: Column) -> Column:
    return format_of(text)["confidence"]


def atomic_facts(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, fact_text, entity, category, quality): sentences of 30 to 500 characters that state something."""
    parts = answers.select(key, F.posexplode(F.split(F.trim(text), r"(?<=[.!?])\s+")).alias("position", "raw")).select(key, "position", F.trim("raw").alias("fact_text"))
    s = F.col("fact_text")
    parts = parts.where(F.length(s).between(30, 500) & ~s.rlike(rf"(?i)^({FILLERS})\b") & ~s.endswith("?"))
    title = F.regexp_extract(s, r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", 1)
    entity = F.when(title != "", title).otherwise(F.regexp_extract(s, r"\b([A-Z][A-Z0-9]{1,})\b", 1))
    category = F.lit("general")
    for name, pattern in reversed(CATEGORIES.items()):
        category = F.when(s.rlike(f"(?i){pattern}"), name).otherwise(category)
    number = s.rlike(r"(?i)\b\d+(?:\.\d+)?(?:%|\$|million|billion|percent)\b")
    parts = parts.select(key, "position", "fact_text", entity.alias("entity"), category.alias("category"), number.alias("number"))
    quality = F.when(F.length("fact_text") < 50, 0.5).otherwise(0.7) + F.when(F.col("entity") != "", 0.1).otherwise(0.0) + F.when(F.col("number"), 0.1).otherwise(0.0)
    quality = quality + F.when(F.col("category").isin("definition", "rule"), 0.1).otherwise(0.0)
    return parts.select(key, F.col("position").cast("long").alias("position"), "fact_text", "entity", "category", F.round(F.least(quality, F.lit(0.9)), 2).alias("quality"))
