"""Rule-based intent of questions: action, mode, format, depth, entities and role, as expressions over a pattern table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (pattern, action, confidence). Of the most confident matches the first counts.
PATTERNS = [
    (r"^extract\b", "extract", 1.0),
    (r"\bextract\s+(all|every|the)\b", "extract", 0.9),
    (r"^convert\b", "convert", 1.0),
    (r"\bconvert\s+.+\s+(?:to|into)\b", "convert", 0.9),
    (r"^count\b", "count", 1.0),
    (r"\bhow many\b", "count", 0.9),
    (r"^calculate\b", "calculate", 1.0),
    (r"^compute\b", "calculate", 0.9),
    (r"\bwhat is\s+\d", "calculate", 0.7),
    (r"^validate\b", "validate", 1.0),
    (r"^verify\b", "validate", 0.9),
    (r"\bis\s+(?:this|it)\s+valid\b", "validate", 0.8),
    (r"^cite\b", "cite", 1.0),
    (r"\bcitation\s+for\b", "cite", 0.9),
    (r"\bcite\s+(?:the|a|an)\b", "cite", 0.9),
    (r"^list\b", "list", 1.0),
    (r"\blist\s+(?:all|every|the|each)\b", "list", 0.9),
    (r"\bgive\s+(?:me\s+)?a\s+list\b", "list", 0.9),
    (r"^quote\b", "quote", 1.0),
    (r"\bquote\s+(?:the|from)\b", "quote", 0.9),
    (r"\bexact\s+(?:text|wording|language)\b", "quote", 0.8),
    (r"^(?:find|search)\b", "find", 1.0),
    (r"\bfind\s+(?:all|every|the|me)\b", "find", 0.9),
    (r"^show\b", "show", 1.0),
    (r"\bshow\s+(?:me|us|the)\b", "show", 0.9),
    (r"^reference\b", "reference", 1.0),
    (r"\breference\s+(?:to|for)\b", "reference", 0.8),
    (r"^(?:lookup|look\s+up)\b", "lookup", 1.0),
    (r"\blook\s*up\b", "lookup", 0.8),
    (r"^what\s+(?:is|are|was|were)\b", "explain", 0.7),
    (r"^who\s+(?:is|are|was|were)\b", "lookup", 0.7),
    (r"^where\s+(?:is|are|was|were)\b", "lookup", 0.7),
    (r"^when\s+(?:is|are|was|were|did)\b", "lookup", 0.7),
    (r"^summarize\b", "summarize", 1.0),
    (r"^(?:give\s+(?:me\s+)?)?(?:a\s+)?summary\b", "summarize", 0.9),
    (r"\bsummarize\s+(?:the|this|that)\b", "summarize", 0.9),
    (r"\btl;?dr\b", "summarize", 0.9),
    (r"^explain\b", "explain", 1.0),
    (r"\bexplain\s+(?:how|why|what|the)\b", "explain", 0.9),
    (r"\bwhat\s+does\s+.+\s+mean\b", "explain", 0.8),
    (r"^compare\b", "compare", 1.0),
    (r"\bcompare\s+.+\s+(?:with|to|and|vs\.?|versus)\b", "compare", 0.9),
    (r"\bcompared\s+to\b", "compare", 0.9),
    (r"\bdifference(?:s)?\s+between\b", "compare", 0.9),
    (r"\bvs\.?\b", "compare", 0.7),
    (r"^contrast\b", "contrast", 1.0),
    (r"\bcontrast\s+.+\s+(?:with|and)\b", "contrast", 0.9),
    (r"^paraphrase\b", "paraphrase", 1.0),
    (r"\bput\s+(?:it|this|that)\s+in\s+(?:simpler|other|different)\s+words\b", "paraphrase", 0.8),
    (r"^translate\b", "translate", 1.0),
    (r"\btranslate\s+.+\s+(?:to|into)\b", "translate", 0.9),
    (r"^analyze\b", "analyze", 1.0),
    (r"^analyse\b", "analyze", 1.0),
    (r"\banalyz(?:e|is)\b", "analyze", 0.8),
    (r"^evaluate\b", "evaluate", 1.0),
    (r"\bevaluate\s+(?:the|this|whether)\b", "evaluate", 0.9),
    (r"^hypothesize\b", "hypothesize", 1.0),
    (r"\bwhat\s+(?:if|would\s+happen)\b", "hypothesize", 0.8),
    (r"^theorize\b", "theorize", 1.0),
    (r"\btheory\s+(?:about|on|behind)\b", "theorize", 0.8),
    (r"^think\b", "think", 1.0),
    (r"\bthink\s+(?:about|through)\b", "think", 0.8),
    (r"\breason\s+(?:about|through)\b", "think", 0.8),
    (r"^debate\b", "debate", 1.0),
    (r"\bpros?\s+and\s+cons?\b", "debate", 0.9),
    (r"\barguments?\s+(?:for|against)\b", "debate", 0.8),
    (r"^predict\b", "predict", 1.0),
    (r"\bwhat\s+will\s+happen\b", "predict", 0.8),
    (r"\bforecast\b", "predict", 0.8),
    (r"^execute\b", "execute", 1.0),
    (r"^run\b", "execute", 0.9),
    (r"^build\b", "build", 1.0),
    (r"^deploy\b", "deploy", 1.0),
    (r"^transform\b", "transform", 1.0),
    (r"\btransform\s+.+\s+(?:to|into)\b", "transform", 0.9),
    (r"^brainstorm\b", "brainstorm", 1.0),
    (r"\bbrainstorm\s+(?:ideas?|ways?|options?)\b", "brainstorm", 0.9),
    (r"^create\b", "create", 1.0),
    (r"^write\b", "write", 1.0),
    (r"\bwrite\s+(?:a|an|the|me)\b", "write", 0.9),
    (r"^draft\b", "draft", 1.0),
    (r"\bdraft\s+(?:a|an|the)\b", "draft", 0.9),
    (r"^generate\b", "generate", 1.0),
    (r"\bgenerate\s+(?:a|an|the|some)\b", "generate", 0.9),
    (r"^compose\b", "compose", 1.0),
    (r"^clarify\b", "clarify", 1.0),
    (r"\bwhat\s+do\s+you\s+mean\b", "clarify", 0.9),
    (r"\bcan\s+you\s+clarify\b", "clarify", 0.9),
]
#: Words that ask for a format, and for a depth; formats, modes and roles of actions; tags; codes that name nothing.
FORMATS = [
    (r"\b(?:as\s+a\s+)?table\b", "table"),
    (r"\b(?:in\s+)?(?:bullet|bulleted)\s*(?:point|list)?s?\b", "bullets"),
    (r"\b(?:as\s+)?json\b", "json"),
    (r"\b(?:as\s+)?csv\b", "csv"),
    (r"\b(?:as\s+|in\s+)?code\b", "code"),
    (r"\b(?:as\s+|in\s+)?markdown\b", "markdown"),
    (r"\b(?:numbered|ordered)\s*list\b", "numbered"),
    (r"\btimeline\b", "timeline"),
    (r"\bdiagram\b", "diagram"),
]
FORMAT_OF_ACTION = {"list": "bullets", "compare": "table", "contrast": "table", "count": "prose", "extract": "json", "convert": "code"}
DEPTHS = [
    (r"\b(?:brief(?:ly)?|short(?:ly)?|quick(?:ly)?|concise(?:ly)?|tl;?dr)\b", "brief"),
    (r"\b(?:detail(?:ed)?|in[\s-]depth|thorough(?:ly)?|comprehensive(?:ly)?)\b", "detailed"),
    (r"\b(?:exhaust(?:ive(?:ly)?)?|everything|all\s+(?:about|there\s+is))\b", "exhaustive"),
    (r"\b(?:full(?:y)?|complete(?:ly)?)\b", "detailed"),
]
DETERMINISTIC = ["extract", "convert", "count", "calculate", "validate"]
ACTIONABLE = ["execute", "build", "deploy", "transform"]
CREATIVE = ["brainstorm", "create", "write", "draft", "generate", "compose"]
NOT_CACHEABLE = ["brainstorm", "create", "compose"]
ROLES = {
    "structurer": ["list", *DETERMINISTIC],
    "synthesizer": ["summarize", "compare", "contrast", "paraphrase", "translate"],
    "reasoner": ["think", "hypothesize", "analyze", "theorize", "evaluate", "debate", "predict"],
    "agent": ACTIONABLE,
    "explorer": CREATIVE,
}
LEGAL, FACTUAL = ["legal", "regulatory", "statute", "regulation", "law"], ["factual", "reference", "encyclopedia"]
COMMON_CODES = (
    "THE AND FOR ARE BUT NOT YOU ALL CAN HER WAS ONE OUR OUT HIS HAS HOW WHO WHY WHAT WHEN WHERE LIST SHOW FIND GIVE MAKE DOES THIS THAT THEM THEN THAN WITH "
    "WILL FROM INTO JUST LIKE HAVE BEEN SOME ALSO EACH MORE ONLY VERY ABOUT BRIEF"
).split()


#: Patterns of what a question names.
QUOTED = "\"[^\"]+\"|'[^']+'"
LINK = r"(https?://[^\s]+)"
ADDRESS = r"\b([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)\b"
PHRASE = r"(?:(?<=\s)|^)(?:(?:the|a|an|of|in|for|to|and|or|by|at|on|with|from)\s+)*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"
QUANTITY = r"\b(\d[\d,]*\.?\d*\s*(?:%|percent|dollars?|USD|EUR|GBP|kg|lb|mi|km|ft|m|cm|mm)?)\b"
CODE = r"\b([A-Z]{2,5})\b"


def intent(question: Column) -> Column:
    """struct(action, confidence): the first match in falling confidence, equal ones in their order."""
    q = F.trim(question)
    ranked = sorted(PATTERNS, key=lambda p: -p[2])
    first = F.coalesce(*(F.when(q.rlike(f"(?i){pattern}"), F.lit(i)) for i, (pattern, _, _) in enumerate(ranked)), F.lit(len(ranked)))
    of = lambda values: F.get(F.array(*map(F.lit, values)), first)
    return F.struct(of([*(a for _, a, _ in ranked), "unknown"]).alias("action"), of([*(c for _, _, c in ranked), 0.0]).alias("confidence"))


def mode(action: Column) -> Column:
    return F.when(action.isin(DETERMINISTIC), "deterministic").when(action.isin(ACTIONABLE), "actionable").when(action.isin(CREATIVE), "creative").otherwise("informational")


def _first(question: Column, table: list[tuple[str, str]], otherwise: Column) -> Column:
    for pattern, name in reversed(table):
        otherwise = F.when(question.rlike(f"(?i){pattern}"), name).otherwise(otherwise)
    return otherwise


def output_format(question: Column, action: Column) -> Column:
    implied = F.lit("auto")
    for name, out in FORMAT_OF_ACTION.items():
        implied = F.when(action == name, out).otherwise(implied)
    return _first(question, FORMATS, implied)


def depth(question: Column) -> Column:
    return _first(question, DEPTHS, F.lit("standard"))


def entities(question: Column) -> Column:
    """Distinct quoted strings, addresses, capitalised phrases, numbers with units and codes, in that order."""
    every = lambda pattern, group=1: F.regexp_extract_all(question, F.lit(pattern), F.lit(group))
    quoted = F.transform(every(QUOTED, 0), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    codes = F.filter(every(CODE), lambda x: (F.length(x) >= 3) & ~x.isin(COMMON_CODES))
    found = F.concat(quoted, every(LINK), every(ADDRESS), every(PHRASE), every(QUANTITY), codes)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def role(action: Column, tags: Column) -> Column:
    """The action's role; law is narrated, not synthesised, and facts are synthesised, not explored."""
    own = F.lit("narrator")
    for name, actions in ROLES.items():
        own = F.when(action.isin(actions), name).otherwise(own)
    lower = F.transform(tags, F.lower)
    has = lambda words: F.arrays_overlap(lower, F.array(*map(F.lit, words)))
    own = F.when((own == "synthesizer") & has(LEGAL), "narrator").otherwise(own)
    return F.when((own == "explorer") & has(FACTUAL), "synthesizer").otherwise(own)


def answers(found: DataFrame, sections: DataFrame, key: str, most: int = 50) -> DataFrame:
    """(query_id, counted, extracted, validated): what needs no model, from found(query_id, key, score, rank).

    extracted: the distinct entities of the ten best snippets of 300 characters, in order, as JSON; null if there are none.
    validated: whether the best of sections(key, title, text) scores over a half.
    """
    rows = found.join(sections.select(key, "title", F.left("text", F.lit(300)).alias("_snippet")), key, "left")
    listed = rows.withColumn("_e", F.when(F.col("rank") <= 10, entities(F.coalesce("_snippet", F.lit("")))).otherwise(F.array().cast("array<string>")))
    sums = listed.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.min(F.struct("rank", "title", "score")).alias("top"),
        F.sort_array(F.collect_list(F.struct("rank", "_e"))).alias("e"),
    )
    every = F.slice(F.array_distinct(F.flatten(F.transform("e", lambda x: x["_e"]))), 1, most)
    good = F.concat(F.lit("Validated: found "), "n", F.lit(" relevant sections. Top match: "), F.col("top.title"), F.lit(" (score: "), F.format_string("%.2f", F.col("top.score")), F.lit(")"))
    return sums.select(
        "query_id",
        F.concat(F.lit("Found "), "n", F.lit(" matching sections.")).alias("counted"),
        F.when(F.size(every) > 0, F.to_json(F.struct(every.alias("entities")))).alias("extracted"),
        F.when(F.col("top.score") > 0.5, good).otherwise("Could not validate: no strong matches found.").alias("validated"),
    )
