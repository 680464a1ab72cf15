"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction. JVM expressions only.

Seeds are matches of the base patterns, values assigned to a word such as `password`, and keys of known form. Each seed
induces patterns: the words to its left and its shape. Patterns and instances form a graph, scored in rounds: a pattern
by the share of its instances' score, an instance by the best of its patterns. What patterns of high confidence extract
and no seed covers is added as spans of kind `secret`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let
from .scratch import spill

#: The base kinds in the order of their spans. Possessive quantifiers keep matching free of recursion and
#: of retries; the look-behinds only bar starts inside a run whose start has failed already. They match the same texts
#: as the plain forms: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Candidates: key blocks; what is assigned or labelled, to the closing quote or white space; groups of up to four letters
#: and digits with spaces between, three or more that hold a digit; and runs of eight or more letters and digits, joined by
#: `-`, `_` or `.` or not, that hold a digit. With up to three words and signs to the left. A look-behind of one character
#: stands before the long ones: it spares these at nearly all places. Look-behinds have bounds, values have none.
GROUP = r"(?=[A-Za-z]*+[0-9])[A-Za-z0-9]"
VALUE = "|".join(
    [
        r"-----BEGIN [A-Z ]++-----[A-Za-z0-9+/=\s]++-----END [A-Z ]++-----",
        r"(?<=[\"'`])(?<=[\p{L}0-9_][\"'`]?[ \t]{0,2}[=:][ \t]{0,2}[\"'`])[^\s\"'`][^\"'`\n]{2,}+(?<=[^\s])(?=[\"'`])",
        rf"(?<![A-Za-z0-9]){GROUP}{{2,4}}+(?: {GROUP}{{2,4}}+){{2,}}+(?![A-Za-z0-9])",
        r"(?<=[=: \t])(?<=[\p{L}0-9_][\"'`]?[ \t]{0,2}[=:][ \t]{0,2})[^\s\"'`=:/][^\s\"'`]+[^\s\"'`,.;:!?)\]}>]",
        r"(?<![A-Za-z0-9])(?=[A-Za-z._-]*+[0-9])(?=[A-Za-z0-9._-]{8})[A-Za-z0-9]++(?:[-_.][A-Za-z0-9]++)*+",
    ]
)
#: Words that take a secret as their value, and forms of keys.
SEED_WORDS = ["password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "access_key", "auth", "bearer", "ssn", "iban", "passwort", "kennwort", "passe", "contraseña", "clave"]
SEED_FORM = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}$|-----BEGIN |eyJ[A-Za-z0-9_-]+\.eyJ)"
#: Longer values of mixed signs have one shape for each kind.
LONGEST_SHAPE = 256
ROUNDS = 3
#: A pattern counts from so many distinct instances on, and from this mean score on; an instance from that score on.
SUPPORT, CONFIDENCE, ACCEPTED = 3, 0.8, 0.8


def placed(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches of a pattern, in code points."""
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("found"))

    def walk(gaps: Column, values: Column) -> Column:
        pairs = F.transform(values, lambda v, i: F.struct(F.length(F.get(gaps, i)).cast("bigint").alias("gap"), v.alias("value")))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["gap"]
            end = start + F.length(x["value"])
            return F.struct(end.cast("bigint").alias("at"), F.array_append(a["found"], F.struct(start.alias("start"), end.cast("bigint").alias("end"), x["value"].alias("value"))).alias("found"))

        return F.aggregate(pairs, begin, step, lambda a: a["found"])

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast(kind)).otherwise(let(F.split(text, pattern, -1), lambda g: walk(g, v))))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + let(F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)),
    )
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\.", -1), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda x: (F.length(x) <= 3) & (F.lpad(x, 3, "0") <= "255")))
    if kind == "card":
        return let(digits, lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) of the base kinds, by kind as listed and then by start."""
    kind_of = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
    parts = []
    for kind, pattern in BASE.items():
        found = _kept(text, kind, pattern)
        parts.append(F.when(F.contains(text, F.lit(NEEDS[kind])) & text.rlike("[0-9]" if kind != "email" else "@"), found).otherwise(F.array().cast(kind_of)))
    return F.concat(*parts)


def _kept(text: Column, kind: str, pattern: str) -> Column:
    found = F.filter(placed(text, pattern), lambda m: valid(kind, m["value"]))
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def candidates(text: Column) -> Column:
    """Array of (start, end, value, lexical, words, shape): what may be identifiers, and the patterns that extract them.

    lexical: the word to the left and its sign; words: two or three of them, or empty. A value without a digit has no
    shape, as words have it too.
    """
    kind_of = "array<struct<start:bigint,end:bigint,value:string,lexical:string,words:string,shape:string>>"

    def described(m: Column) -> Column:
        value = m["value"]
        left = F.substring(text, F.greatest(m["start"] - 39, F.lit(1)).cast("int"), F.least(m["start"], F.lit(40)).cast("int"))
        lexical = F.lower(F.regexp_extract(left, r"([\p{L}_]{2,24})[\"'`]?\s*([=:]?)[\s\"'`(\[<]*$", 0))
        lexical = F.regexp_replace(lexical, r"[\s\"'`(\[<]+", "")
        words = F.lower(F.regexp_extract(left, r"((?:[\p{L}_]{2,24}\s+){1,2}[\p{L}_]{2,24}[\"'`]?\s*[=:]?)[\s\"'`(\[<]*$", 1))
        words = F.regexp_replace(F.regexp_replace(words, r"[\"'`]+", ""), r"\s+", " ")
        letters = F.regexp_extract(value, "^[A-Z]{2,4}", 0)
        kinds = F.when(value.rlike("^[0-9]+$"), "9").when(value.rlike("^[0-9a-f]+$"), "x").when(value.rlike("^[A-Z0-9]+$"), F.concat(F.lit("U"), letters)).when(value.rlike("^[a-z0-9]+$"), "l").otherwise("a")
        mask = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Z]", "U"), "[a-z]", "l")
        shape = F.when(~value.rlike("[0-9]"), "").when(value.rlike("[^A-Za-z0-9]"), F.when(F.length(value) > LONGEST_SHAPE, F.concat(F.lit("long "), kinds)).otherwise(mask)).otherwise(F.concat(kinds, F.length(value).cast("string")))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), value.alias("value"), lexical.alias("lexical"), words.alias("words"), shape.alias("shape"))

    found = F.transform(placed(text, VALUE), described)
    return F.when(text.rlike("[0-9=:]"), found).otherwise(F.array().cast(kind_of))


def confident(instances: DataFrame) -> DataFrame:
    """(value) of the instances of (value, lexical, words, shape, seed) that patterns of high confidence extract.

    A round scores each pattern by the mean score of its distinct instances, and gives each instance the best score of
    a pattern with support. Both tables shrink to distinct rows before any shuffle back; a round's scores are written.
    """
    edges = instances.select("value", "seed", F.explode(F.array(F.concat(F.lit("L:"), "lexical"), F.concat(F.lit("W:"), "words"), F.concat(F.lit("S:"), "shape"))).alias("pattern"))
    edges = spill(edges.where("pattern not in ('L:', 'W:', 'S:')").groupBy("value", "pattern").agg(F.max("seed").cast("double").alias("seed")))
    scores = spill(edges.groupBy("value").agg(F.max("seed").alias("score")))
    for _ in range(ROUNDS):
        scored = edges.join(scores, "value")
        patterns = scored.groupBy("pattern").agg(F.avg("score").alias("mean"), F.count("*").alias("support"))
        patterns = spill(patterns.where((F.col("support") >= SUPPORT) & (F.col("mean") >= CONFIDENCE)))
        reached = edges.join(patterns.select("pattern", "mean"), "pattern", "left").groupBy("value").agg(F.greatest(F.max("seed"), F.coalesce(F.max("mean"), F.lit(0.0))).alias("score"))
        scores = spill(reached)
    return scores.where(F.col("score") >= ACCEPTED).select("value")


def find(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(row, spans): row holds the columns; spans is the array of (kind, start, end), base kinds first.

    A null text is empty. Columns may have any names. Repeated rows stay, each with its own spans. An added span never
    overlaps a base span. Code points count, ends are exclusive. An empty table gives none. A very long text is matched
    whole, in one row, in time that grows with its length. Runs jobs while it is built.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*columns).alias("row"), text.alias("text")).select("row", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("near"))
    rows = spill(rows.withColumn("rid", F.monotonically_increasing_id()))  # written, so that the ids stay as they are
    free = F.filter("near", lambda n: ~F.exists("base", lambda b: (b["start"] < n["end"]) & (n["start"] < b["end"])))
    seen = rows.where(F.size("near") > 0)
    value = F.col("n.value")
    # A word without a digit is the same value only after the same word.
    name = F.when(value.rlike("[0-9]"), F.xxhash64(value)).otherwise(F.xxhash64(value, "n.lexical"))
    within = value.rlike("^[A-Za-z0-9]+$")  # a longer value is no seed because of a part of it that a base span shares
    seeds = F.col("n.lexical").rlike(f"(?:{'|'.join(SEED_WORDS)})[=:]$") | value.rlike(SEED_FORM) | F.exists("base", lambda b: ((b["start"] < F.col("n.end")) & (F.col("n.start") < b["end"]) & within) | ((b["start"] >= F.col("n.start")) & (b["end"] <= F.col("n.end"))))
    instances = seen.select("base", F.explode("near").alias("n")).select(name.alias("value"), "n.lexical", "n.words", "n.shape", seeds.alias("seed"))
    instances = instances.groupBy("value", "lexical", "words", "shape").agg(F.max("seed").alias("seed"))
    accepted = spill(confident(instances))
    open_spans = seen.select("rid", F.explode(free).alias("n")).select("rid", "n.start", "n.end", name.alias("value"))
    added = open_spans.join(accepted, "value").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(F.lit("secret").alias("kind"), "start", "end"))).alias("added"))
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return rows.join(spill(added), "rid", "left").select("row", F.concat(plain, F.coalesce("added", none)).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first to start, then the longest, counts."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        added = F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.when(s["start"] >= a["at"], F.struct((-s["back"]).cast("bigint").alias("at"), F.concat(a["parts"], added).alias("parts"))).otherwise(a)

    joined = F.aggregate(ordered, begin, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(joined)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(list(BASE)))
    return out.select("row.doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row of docs, its personal data replaced in text, and n_chars to match.

    Null texts stay null and empty ones empty; repeated rows stay. See `find`.
    """
    out = find(docs, docs.columns).withColumn("clean", redact(F.col("row.text"), F.col("spans")))
    changed = {"text": F.col("clean").alias("text"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("bigint")).otherwise(F.col("row.n_chars")).alias("n_chars")}
    return out.select(*(changed.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns))
