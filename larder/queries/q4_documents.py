"""Documents: parsing, chunking, blocks, tags and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import chunking as K
from larder.operators import rules as R
from larder.session import table
from larder.sources import parsers as P

from . import query


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("chunk_fixed", r"""WITH pieces AS (SELECT doc_id, pos AS char_offset, regexp_replace(substr(text, CAST(pos AS INTEGER) + 1, 500), '^\s+|\s+$', '', 'g') AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS pos FROM documents))
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_offset) - 1 AS chunk_index, char_offset, chunk FROM pieces WHERE length(chunk) >= 50""")
def chunk_fixed(spark, sf_dir):
    return K.fixed(_docs(spark, sf_dir), "doc_id")


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    return K.table_function(_docs(spark, sf_dir), "doc_id", ["text"], lambda t: K.recursive(t or ""), "chunk_index long, char_offset long, chunk string")


@query("chunk_semantic")
def chunk_semantic(spark, sf_dir):
    return K.table_function(_docs(spark, sf_dir), "doc_id", ["text"], lambda t: K.semantic(t or ""), "chunk_index long, char_offset long, chunk string")


@query("chunk_code")
def chunk_code(spark, sf_dir):
    """Document lines stand in for code; each fifth line is given a definition."""
    lines = F.transform(F.split("text", r"[.]\s"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("def f"), i.cast("string"), F.lit("(): # "), x)).otherwise(x))
    code = _docs(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("text"), F.lit("python").alias("language"))
    return K.table_function(code, "doc_id", ["text", "language"], lambda t, lang: K.code(t or "", lang), "chunk_index long, first_line long, last_line long, symbol string, chunk string")


@query("sections_csv_groups", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rn FROM customer)
  SELECT c_nationkey, rn // 50 AS part, 'Rows ' || (min(rn) + 1) || '-' || (max(rn) + 1) AS title, string_agg('c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment, chr(10) ORDER BY rn) AS body FROM n GROUP BY c_nationkey, rn // 50""")
def sections_csv_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment")
    return P.csv_sections(rows, ["c_nationkey"], "c_custkey", ["c_custkey", "c_name", "c_mktsegment"])


TRIMMED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("markdown_sections", rf"""WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  marked AS (SELECT doc_id, source, pos, CASE WHEN pos % 4 = 1 THEN '## ' || line ELSE ' ' || line END AS line FROM lines), judged AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+.+$') AS is_heading FROM marked),
  grouped AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM judged),
  parts AS (SELECT doc_id, any_value(source) AS source, part, max(CASE WHEN is_heading THEN {TRIMMED.format("regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)")} END) AS heading, count(*) FILTER (NOT is_heading) AS n, {TRIMMED.format("coalesce(string_agg(CASE WHEN NOT is_heading THEN line END, chr(10) ORDER BY pos), '')")} AS body, part = max(part) OVER (PARTITION BY doc_id) AS last FROM grouped GROUP BY doc_id, part),
  kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS section FROM parts WHERE CASE WHEN last THEN body <> '' ELSE n > 0 END)
  SELECT doc_id, section, coalesce(heading, source) AS title, source || ' > ' || coalesce(heading, source) AS path, sha256(body) AS version_hash FROM kept
  UNION ALL SELECT doc_id, 0, source, '', sha256({TRIMMED.format("marked_text")}) FROM (SELECT doc_id, any_value(source) AS source, string_agg(line, chr(10) ORDER BY pos) AS marked_text FROM marked GROUP BY doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM kept)""")
def markdown_sections(spark, sf_dir):
    """Each fourth line becomes a heading, as these documents have none."""
    marked = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## "), x)).otherwise(F.concat(F.lit(" "), x))), "\n")
    found = P.markdown_sections(_docs(spark, sf_dir).select("doc_id", "source", marked.alias("text")), "doc_id", title="source")
    return found.select("doc_id", "section", "title", F.array_join("hierarchy", " > ").alias("path"), F.sha2("body", 256).alias("version_hash"))


@query("paragraph_sections", """WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS ps FROM documents),
  steps AS (
    SELECT doc_id, ps, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS section, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS own FROM d
    UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN held + length(ps[i + 1]) > 2000 THEN section + 1 ELSE section END, CASE WHEN held + length(ps[i + 1]) > 2000 THEN 0 ELSE held + length(ps[i + 1]) END, section FROM steps WHERE i < len(ps)),
  parts AS (SELECT doc_id, own AS section, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS body FROM steps WHERE i > 0 GROUP BY doc_id, own)
  SELECT doc_id, section, 'Section ' || section AS title, sha256(body) AS body_hash FROM parts UNION ALL SELECT doc_id, 0, 'Content', sha256('') FROM d WHERE len(ps) = 0""")
def paragraph_sections(spark, sf_dir):
    """Lines stand in for paragraphs, as these documents have no blank lines."""
    rows = _docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return P.paragraph_sections(rows, "doc_id").select("doc_id", "section", "title", F.sha2("body", 256).alias("body_hash"))


JSON_SQL = """WITH made AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"k": ' || user_id || ', "type": "' || event_type || '", "at": {"deep": [' || event_id || ', null]}, "ok": ' || (event_id % 2 = 0) || ', "none": null}'
    WHEN 1 THEN '[' || event_id || ', "' || event_type || '", [true], {"a": 1}]' WHEN 2 THEN '"' || event_type || '"' WHEN 3 THEN CAST(event_id AS VARCHAR) ELSE props END AS body FROM events),
  parts AS (SELECT event_id, json_type(body) AS t, body FROM made),
  members AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY name) - 1 AS position, name, json_extract(body, '$."' || name || '"') AS v FROM (SELECT event_id, body, unnest(json_keys(body)) AS name FROM parts WHERE t = 'OBJECT')),
  items AS (SELECT event_id, CAST(i AS BIGINT) AS position, NULL AS name, json_extract(body, '$[' || i || ']') AS v FROM (SELECT event_id, body, unnest(range(CAST(json_array_length(body) AS BIGINT))) AS i FROM parts WHERE t = 'ARRAY')),
  every AS (SELECT * FROM members UNION ALL SELECT * FROM items UNION ALL SELECT event_id, 0, NULL, CAST(body AS JSON) FROM parts WHERE t NOT IN ('OBJECT', 'ARRAY'))
  SELECT event_id, position, name, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'truth' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
    CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' ELSE replace(CAST(v AS VARCHAR), ' ', '') END AS value FROM every"""


@query("json_values", JSON_SQL)
def json_values(spark, sf_dir):
    """Objects, lists, scalars and nested values, each with its kind."""
    e = F.col("event_id")
    events = table(spark, sf_dir, "events")
    whole = F.concat(F.lit('{"k": '), "user_id", F.lit(', "type": "'), "event_type", F.lit('", "at": {"deep": ['), e, F.lit(', null]}, "ok": '), (e % 2 == 0).cast("string"), F.lit(', "none": null}'))
    listed = F.concat(F.lit("["), e, F.lit(', "'), "event_type", F.lit('", [true], {"a": 1}]'))
    body = F.when(e % 5 == 0, whole).when(e % 5 == 1, listed).when(e % 5 == 2, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(e % 5 == 3, e.cast("string")).otherwise(F.col("props"))
    return P.json_values(events.select("event_id", body.alias("body")), "event_id", "body")


@query("json_sections", """SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events""")
def json_sections(spark, sf_dir):
    return P.json_sections(table(spark, sf_dir, "events"), "event_id", "props")


@query("parse_html")
def parse_html(spark, sf_dir):
    return P.html_sections(table(spark, sf_dir, "pages"), "page_id", "html")


@query("headline", r"""SELECT doc_id, CASE WHEN regexp_extract(trim(text), '^(.+?[.!?])\s', 1) <> '' AND length(trim(regexp_extract(trim(text), '^(.+?[.!?])\s', 1))) <= 200 THEN trim(regexp_extract(trim(text), '^(.+?[.!?])\s', 1))
  WHEN length(trim(text)) <= 120 THEN trim(text) WHEN strpos(left(trim(text), 120), ' ') > 0 AND 120 - strpos(reverse(left(trim(text), 120)), ' ') > 40 THEN left(trim(text), 120 - strpos(reverse(left(trim(text), 120)), ' ')) || '...' ELSE left(trim(text), 120) || '...' END AS headline FROM documents""")
def headline(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.headline(F.lit(""), F.col("text")).alias("headline"))


LINES_SQL = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _count_sql(pattern: str) -> str:
    return f"len(list_filter(ls, lambda x: regexp_matches(x, '{pattern}')))"


PIPES_SQL = "len(list_filter(ls, lambda x: length(x) - length(replace(x, '|', '')) >= 2))"


@query("structured_type", rf"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN {PIPES_SQL} >= 2 THEN 'table' WHEN {_count_sql(r'^[^:]{1,60}:\s+.+')} >= 2 THEN 'key_value'
  WHEN {_count_sql(r'^[\-\*•‣]\s+')} >= 2 THEN 'bullet_list' WHEN {_count_sql(r'^\d+[.)]\s+')} >= 2 THEN 'numbered_list' ELSE 'narrative' END AS type FROM (SELECT doc_id, text, {LINES_SQL} AS ls FROM documents)""")
def structured_type(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.structured_type(F.col("text")).alias("type"))


def _all_sql(pattern: str) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{pattern}'))), ';')"


@query("narrative_facts", rf"""SELECT doc_id, coalesce({_all_sql(r'(?i)\$[\d,]+(?:\.\d{2})?(?:\s*(?:million|billion|trillion))?')}, '') AS amounts, coalesce({_all_sql(r'\d+(?:\.\d+)?%')}, '') AS percentages, coalesce({_all_sql(r'\d+\s+[A-Z][A-Za-z.]+\s+§\s*\d+')}, '') AS citations FROM documents""")
def narrative_facts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *(F.array_join(R.facts(F.col("text"), k), ";").alias(k) for k in ("amounts", "percentages", "citations")))


@query("narrative_names")
def narrative_names(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *(R.facts(F.col("text"), k).alias(k) for k in ("dates", "codes", "proper_nouns")))


def _domain_sql() -> str:
    hits = {n: " + ".join(f"CASE WHEN contains(s, '{w}') THEN 1 ELSE 0 END" for w in words) for n, words in R.DOMAINS.items()}
    cols = ", ".join(f"{h} AS h{i}" for i, h in enumerate(hits.values()))
    best = "greatest(" + ", ".join(f"h{i}" for i in range(len(hits))) + ")"
    pick = " ".join(f"WHEN h{i} = best THEN '{n}'" for i, n in enumerate(hits))
    return f"""SELECT doc_id, CASE WHEN best < 1 THEN 'general' ELSE CASE {pick} END END AS domain, CAST(CASE WHEN best >= 3 THEN 0.9 WHEN best >= 1 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence
      FROM (SELECT *, {best} AS best FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, lower(source || '  ' || left(text, 500)) AS s FROM documents)))"""


@query("tags_domain", _domain_sql())
def tags_domain(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.domain(F.col("lang"), F.col("source"), F.col("text")).alias("d")).select("doc_id", "d.domain", "d.confidence")


TOPIC_STOPS = ", ".join(f"'{w}'" for w in R.TOPIC_STOPS)


@query("tags_topics", rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}') AND x NOT IN ({TOPIC_STOPS})) AS ws FROM documents),
  e AS (SELECT doc_id, unnest(ws) AS topic, generate_subscripts(ws, 1) AS pos FROM w), c AS (SELECT doc_id, topic, count(*) AS n, min(pos) AS pos FROM e GROUP BY doc_id, topic)
  SELECT doc_id, topic, n, round(least(0.7, 0.3 + n * 0.1), 2) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM c) WHERE r <= 3 AND n >= 2""")
def tags_topics(spark, sf_dir):
    return R.topics(_docs(spark, sf_dir), "doc_id")


@query("tags_entity_type", " UNION ALL ".join(
    rf"SELECT doc_id, '{k}' AS type, round(least(0.95, 0.6 + n * 0.1), 2) AS confidence FROM (SELECT doc_id, len(regexp_extract_all(text, '{p}')) AS n FROM documents) WHERE n > 0" for k, p in R.ENTITY_TYPES.items()))
def tags_entity_type(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(R.entity_types(F.col("text"))).alias("t")).select("doc_id", "t.type", "t.confidence")


@query("tags_entities")
def tags_entities(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(R.entities(F.col("text"))).alias("position", "e")).select("doc_id", "position", "e.value", "e.confidence")


@query("tags_complexity", r"""SELECT doc_id, CASE WHEN n = 0 THEN 'simple' WHEN n > 500 AND d > 0.5 THEN 'high' WHEN n > 200 OR d > 0.6 THEN 'medium' ELSE 'low' END AS complexity
  FROM (SELECT doc_id, len(ws) AS n, CAST(len(list_distinct(ws)) AS DOUBLE) / greatest(len(ws), 1) AS d FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents))""")
def tags_complexity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.complexity(F.col("text")).alias("complexity"))


@query("tags_format_hint", rf"""SELECT doc_id, CASE WHEN len(ls) = 0 THEN 'simple' WHEN {PIPES_SQL} >= 2 THEN 'structured_data' WHEN {_count_sql(chr(92) + 't')} >= 2 THEN 'structured_data' WHEN {_count_sql(r'^[\-\*•\d]+[.)]\s+|^[\-\*•]\s+')} >= 3 THEN 'list'
  WHEN {_count_sql(r'^[^:]{1,60}:\s+.+')} >= 2 THEN 'structured_data' WHEN n < 30 THEN 'simple' ELSE 'narrative' END AS hint FROM (SELECT doc_id, {LINES_SQL} AS ls, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents)""")
def tags_format_hint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.format_hint(F.col("text")).alias("hint"))


@query("atomic_facts", r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS raw, generate_subscripts(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) - 1 AS position FROM documents),
  f AS (SELECT doc_id, position, trim(raw) AS fact_text FROM s)
  SELECT doc_id, CAST(position AS BIGINT) AS position, sha256(fact_text) AS fact_hash FROM f WHERE length(fact_text) BETWEEN 30 AND 500 AND NOT regexp_matches(fact_text, '(?i)^(""" + R.FILLERS + r""")\b') AND NOT ends_with(fact_text, '?')""")
def atomic_facts(spark, sf_dir):
    return R.atomic_facts(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "position", F.sha2("fact_text", 256).alias("fact_hash"))


@query("atomic_fact_kinds")
def atomic_fact_kinds(spark, sf_dir):
    """With entity, category and quality: word boundaries beside accents differ in SQL, so a test has a plain version."""
    return R.atomic_facts(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "position", "entity", "category", "quality")


TYPE_SQL = rf"""CASE WHEN trim(text) = '' THEN 'empty' WHEN {PIPES_SQL} >= 2 THEN 'table' WHEN {_count_sql(r'^[^:]{1,60}:\s+.+')} >= 2 THEN 'key_value'
  WHEN {_count_sql(r'^[\-\*•‣]\s+')} >= 2 THEN 'bullet_list' WHEN {_count_sql(r'^\d+[.)]\s+')} >= 2 THEN 'numbered_list' ELSE 'narrative' END"""
#: Documents made into each kind of structure in turn.
MADE_SQL = r"""made AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Name | Kind' || chr(10) || '--- | ---' || chr(10) || 'a |' || lang || '| x' || chr(10) || '| ' || doc_id || ' | b |' WHEN 1 THEN 'lang: ' || lang || chr(10) || 'id: ' || doc_id || chr(10) || 'lang: again'
  WHEN 2 THEN '- ' || lang || chr(10) || '* item ' || doc_id || chr(10) || 'text' WHEN 3 THEN '1. ' || lang || chr(10) || '2) item ' || doc_id ELSE text END AS text FROM documents)"""


def _made(spark, sf_dir):
    d, lang = F.col("doc_id"), F.col("lang")
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    text = (
        F.when(d % 5 == 0, line("Name | Kind\n--- | ---\na |", lang, "| x\n| ", d, " | b |"))
        .when(d % 5 == 1, line("lang: ", lang, "\nid: ", d, "\nlang: again"))
        .when(d % 5 == 2, line("- ", lang, "\n* item ", d, "\ntext"))
        .when(d % 5 == 3, line("1. ", lang, "\n2) item ", d))
        .otherwise(F.col("text"))
    )
    return _docs(spark, sf_dir).select("doc_id", text.alias("text"))


@query("structured_payload", rf"""WITH {MADE_SQL}, l AS (SELECT doc_id, text, {LINES_SQL} AS ls FROM made), t AS (SELECT *, {TYPE_SQL} AS type FROM l),
  c AS (SELECT *, list_transform(list_filter(ls, lambda x: length(x) - length(replace(x, '|', '')) >= 2), lambda x: list_filter(list_transform(string_split(x, '|'), lambda y: trim(y)), lambda y: y <> '' AND NOT regexp_matches(y, '^-+$'))) AS cells,
         list_filter(ls, lambda x: regexp_matches(x, '^[^:]{{1,60}}:\s+.+')) AS kv FROM t)
  SELECT doc_id, type, CASE WHEN type = 'table' THEN array_to_string(coalesce(cells[1], []), ',') END AS headers,
    CASE WHEN type = 'table' THEN array_to_string(list_transform(list_filter(cells[2:], lambda r: len(r) > 0), lambda r: array_to_string(r, ',')), ';') END AS cells,
    CASE WHEN type = 'key_value' THEN (SELECT string_agg(k || '=' || v, ';' ORDER BY p) FROM (SELECT k, min(p) AS p, max_by(v, p) AS v FROM (SELECT trim(regexp_extract(x, '^([^:]{{1,60}}):\s+(.+)', 1)) AS k, trim(regexp_extract(x, '^([^:]{{1,60}}):\s+(.+)', 2)) AS v, p FROM (SELECT unnest(kv) AS x, generate_subscripts(kv, 1) AS p)) GROUP BY k)) END AS data,
    CASE WHEN type = 'bullet_list' THEN array_to_string(list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^[\-\*•‣]\s+')), lambda x: regexp_replace(regexp_replace(x, '^[\-\*•‣]\s+', ''), '^\d+[.)]\s+', '')), lambda x: x <> ''), ';')
         WHEN type = 'numbered_list' THEN array_to_string(list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^\d+[.)]\s+')), lambda x: regexp_replace(regexp_replace(x, '^[\-\*•‣]\s+', ''), '^\d+[.)]\s+', '')), lambda x: x <> ''), ';') END AS items FROM c""")
def structured_payload(spark, sf_dir):
    """What tables, keys and lists hold."""
    p = _made(spark, sf_dir).select("doc_id", R.structured(F.col("text")).alias("p")).select("doc_id", "p.*")
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    data = F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return p.select("doc_id", "type", F.array_join("headers", ",").alias("headers"), cells.alias("cells"), data.alias("data"), F.array_join("items", ";").alias("items"))


@query("blocks", rf"""WITH h AS (SELECT doc_id, text, trim(text) AS body, regexp_extract(trim(text), '^(.+?[.!?])\s', 1) AS sentence FROM documents),
  b AS (SELECT doc_id, text, CASE WHEN sentence <> '' AND length(trim(sentence)) <= 200 THEN trim(sentence) WHEN length(body) <= 120 THEN body WHEN strpos(left(body, 120), ' ') > 0 AND 120 - strpos(reverse(left(body, 120)), ' ') > 40 THEN left(body, 120 - strpos(reverse(left(body, 120)), ' ')) || '...' ELSE left(body, 120) || '...' END AS head FROM h),
  n AS (SELECT *, greatest(1, CAST(floor(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 1.3) AS BIGINT)) AS nt, greatest(1, CAST(floor(len(list_filter(string_split_regex(head, '\s+'), lambda x: x <> '')) * 1.3) AS BIGINT)) AS nh FROM b)
  SELECT doc_id, 'full' AS compression, sha256(text) AS content_hash, sha256(text) AS version_hash, nt AS token_count FROM n UNION ALL SELECT doc_id, 'headline', sha256(head), sha256(text), nh FROM n
  UNION ALL SELECT doc_id, 'structured', NULL, sha256(text), nt FROM n""")
def blocks(spark, sf_dir):
    """Three blocks of each section; what the structured one holds is a query of its own."""
    found = R.blocks(_docs(spark, sf_dir), "doc_id", F.lit(""))
    return found.select("doc_id", "compression", F.when(F.col("compression") != "structured", F.sha2("content", 256)).alias("content_hash"), "version_hash", "token_count")


@query("generate_tags", rf"""WITH d AS ({_domain_sql()}), docs AS (SELECT doc_id, text, source, lang, {LINES_SQL} AS ls, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents),
  w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}') AND x NOT IN ({TOPIC_STOPS})) AS ws FROM documents), e AS (SELECT doc_id, unnest(ws) AS topic, generate_subscripts(ws, 1) AS pos FROM w),
  c AS (SELECT doc_id, topic, count(*) AS n, min(pos) AS pos FROM e GROUP BY doc_id, topic), f AS (SELECT doc_id, topic, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM c) WHERE r <= 3 AND n >= 2),
  v AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents), x AS (SELECT doc_id, len(ws) AS n, CAST(len(list_distinct(ws)) AS DOUBLE) / greatest(len(ws), 1) AS d FROM v),
  every AS (
    SELECT doc_id, 'domain' AS tag_key, domain AS tag_value, confidence FROM d
    UNION ALL SELECT doc_id, 'topic', lower(trim(source)), 0.95 FROM docs WHERE trim(source) <> '' UNION ALL SELECT doc_id, 'topic', 'archive', 0.8 FROM docs UNION ALL SELECT doc_id, 'topic', lower(trim(source)), 0.8 FROM docs WHERE length(trim(source)) > 2
    UNION ALL SELECT doc_id, 'topic', topic, round(least(0.7, 0.3 + n * 0.1), 2) FROM f
    UNION ALL SELECT doc_id, 'complexity', CASE WHEN n = 0 THEN 'simple' WHEN n > 500 AND d > 0.5 THEN 'high' WHEN n > 200 OR d > 0.6 THEN 'medium' ELSE 'low' END, CASE WHEN n = 0 THEN 1.0 WHEN n > 500 AND d > 0.5 THEN 0.85 WHEN n > 200 OR d > 0.6 THEN 0.8 ELSE 0.85 END FROM x
    UNION ALL SELECT doc_id, 'format_hint', CASE WHEN len(ls) = 0 THEN 'simple' WHEN {PIPES_SQL} >= 2 THEN 'structured_data' WHEN {_count_sql(chr(92) + 't')} >= 2 THEN 'structured_data' WHEN {_count_sql(r'^[\-\*•\d]+[.)]\s+|^[\-\*•]\s+')} >= 3 THEN 'list' WHEN {_count_sql(r'^[^:]{1,60}:\s+.+')} >= 2 THEN 'structured_data' WHEN n < 30 THEN 'simple' ELSE 'narrative' END,
      CASE WHEN len(ls) = 0 THEN 1.0 WHEN {PIPES_SQL} >= 2 THEN 0.95 WHEN {_count_sql(chr(92) + 't')} >= 2 THEN 0.85 WHEN {_count_sql(r'^[\-\*•\d]+[.)]\s+|^[\-\*•]\s+')} >= 3 THEN 0.9 WHEN {_count_sql(r'^[^:]{1,60}:\s+.+')} >= 2 THEN 0.8 WHEN n < 30 THEN 0.9 WHEN n / len(ls) > 15 THEN 0.85 ELSE 0.7 END FROM docs
    UNION ALL {" UNION ALL ".join(rf"SELECT doc_id, 'entity_type', '{k}', round(least(0.95, 0.6 + n * 0.1), 2) FROM (SELECT doc_id, len(regexp_extract_all(text, '{p}')) AS n FROM documents) WHERE n > 0" for k, p in R.ENTITY_TYPES.items())})
  SELECT doc_id, tag_key, tag_value, CAST(max(confidence) AS DOUBLE) AS confidence FROM every GROUP BY doc_id, tag_key, tag_value""")
def generate_tags(spark, sf_dir):
    """All tags but entities, which are a query of their own; the hierarchy is `archive/<source>`."""
    docs = _docs(spark, sf_dir)
    found = R.tags(docs, "doc_id", F.lit(""), F.col("source"), F.concat(F.lit("archive/"), "source"))
    return found.where("tag_key <> 'entities'").select("doc_id", "tag_key", "tag_value", "confidence")
