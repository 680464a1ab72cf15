"""Parts of operators that SQL can express, as queries of their own: the counts of the quality rules, the base spans of personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from .pii import BASE, base_spans
from .quality_rules import COMMON_WORDS, features

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY_COUNTS_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
  w AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 7), ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
  r AS (SELECT doc_id, s FROM w GROUP BY doc_id, s HAVING count(*) > 1), c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM w JOIN r USING (doc_id, s) CROSS JOIN (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
  n AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id))
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM n"""


def quality_counts(spark, sf_dir: str):
    found = features(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], COMMON_WORDS)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


#: The plain patterns of the base kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
#: Each second digit from the right is doubled, less nine if it is over nine.
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: list_transform([CAST({DIGITS}[length({DIGITS}) - i + 1] AS INTEGER)], lambda x: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)[1])) % 10 = 0"
VALID = {
    "email": "true",
    "ip": r"len(list_filter(string_split(v, '.'), lambda x: length(regexp_replace(x, '^0+', '')) > 3 OR CAST('0' || right(regexp_replace(x, '^0+', ''), 4) AS INTEGER) > 255)) = 0",
    "card": f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
}


def _kind_sql(number: int, kind: str) -> str:
    """The valid matches of one kind, with their places from the gaps between them."""
    p = PLAIN[kind]
    return f"""k{number} AS (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS vs, string_split_regex(text, '{p}') AS gaps FROM d),
  m{number} AS (SELECT doc_id, unnest(vs) AS v, generate_subscripts(vs, 1) AS n, vs, gaps FROM k{number}),
  p{number} AS (SELECT doc_id, {number} AS o, '{kind}' AS kind, v, CAST(list_sum(list_transform(gaps[:n], lambda x: length(x))) + coalesce(list_sum(list_transform(vs[:n - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM m{number} WHERE {VALID[kind]}),"""


PERSONAL_BASE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {"".join(_kind_sql(i, k) for i, k in enumerate(PLAIN))}
  every AS ({" UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(PLAIN)))}),
  listed AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || (start + length(v)), ',' ORDER BY o, start) AS spans, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in PLAIN)} FROM every GROUP BY doc_id)
  SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in PLAIN)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN listed USING (doc_id)"""


def personal_base(spark, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", base_spans(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("spans"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(listed, 256).alias("base_sha256"))
