"""Registered queries that SQL can't express, on the smallest tables, against plain versions written one row at a time."""

import json
import re
from itertools import groupby

import numpy as np
import pandas as pd
import pytest

from larder.functions import text as T
from larder.operators import intents as I
from larder.operators import rules as R
from larder.queries import QUERIES


@pytest.fixture(scope="module")
def docs(small):
    return pd.read_parquet(f"{small}/documents.parquet")


def rows(spark, small, name):
    return [r.asDict(recursive=True) for r in QUERIES[name](spark, small).collect()]


def tokens(text):
    return [w for w in re.sub(r"[^\w\s]", " ", text.lower()).split() if w not in T.STOPWORDS]


def exchanges(small):
    turns = pd.read_parquet(f"{small}/conversations.parquet").sort_values(["conv_id", "turn"]).to_dict("records")
    for one, after in zip(turns, [*turns[1:], None]):
        if one["role"] == "user":
            answered = after and after["conv_id"] == one["conv_id"] and after["role"] == "assistant"
            yield one["conv_id"] * 100 + one["turn"], one["conv_id"], one["text"], after["text"] if answered else None


def edits(a, b):
    row = np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b])
    for i, x in enumerate(a, 1):
        change = np.minimum(row[:-1] + (codes != ord(x)), row[1:] + 1)
        row = np.minimum.accumulate(np.append(i, change) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def edit_similarity(a, b):
    return 1 - edits(a, b) / max(len(a), len(b)) if a or b else 1.0


def fuzzy(a, b):
    x, y = set(a.split()), set(b.split())
    jaccard = len(x & y) / len(x | y) if x | y else 0.0
    overlap = len(x & y) / min(len(x), len(y)) if x and y else 0.0
    return 0.6 * (0.4 * jaccard + 0.6 * overlap) + 0.4 * edit_similarity(a, b)


@pytest.mark.parametrize("name,measure", [("levenshtein_similarity", edit_similarity), ("fuzzy_similarity", fuzzy)])
def test_similarities(spark, small, name, measure):
    pairs = {i: (" ".join(tokens(q)), " ".join(tokens(a))) for i, _, q, a in exchanges(small) if a is not None}
    got = {r["question_id"]: r["similarity"] for r in rows(spark, small, name)}
    assert got.keys() == pairs.keys() and all(abs(got[i] - measure(*pairs[i])) < 2e-6 for i in pairs)


def test_fuzzy_topk(spark, small):
    stored = {i: " ".join(tokens(q)) for i, _, q, a in exchanges(small) if a is not None}
    texts = {i: q for i, _, q, a in exchanges(small) if a is not None}
    want = []
    for i in (i for i in stored if i % 100 == 0):
        asked = tokens(texts[i][:-2] + "x" + texts[i][-2:])
        longest = sorted(set(asked), key=lambda w: (-len(w), w))[:2]
        if not longest:
            continue
        found = [j for j, s in stored.items() if all(w in s for w in longest)] or [j for j, s in stored.items() if longest[0] in s]
        scored = sorted((-round(s, 6), j) for j in found if (s := fuzzy(" ".join(sorted(asked)), stored[j])) >= 0.3)
        want += [(i, j, -s, n) for n, (s, j) in enumerate(scored[:3], 1)]
    got = [(r["question_id"], r["cache_id"], r["similarity"], r["rank"]) for r in rows(spark, small, "fuzzy_topk")]
    assert [g[:2] + g[3:] for g in sorted(got)] == [w[:2] + w[3:] for w in sorted(want)] and want


def test_fact_merge(spark, small, docs):
    """Facts stored one after another, on the same vectors."""
    from pyspark.sql import functions as F

    from larder.functions.vectors import hashed_embedding
    from larder.operators import rules

    found = rules.atomic_facts(spark.read.parquet(f"{small}/documents.parquet").where(F.length("text") >= 100), "doc_id", "text")
    facts = sorted(found.select("doc_id", "position", "fact_text", hashed_embedding(F.col("fact_text")).alias("v")).collect())
    stored, serves, seen = np.empty((0, 64)), {}, {}
    for doc, group in groupby(facts, key=lambda r: r["doc_id"]):
        for n, r in enumerate(list(group)[:10], 1):
            v = np.array(r["v"])
            near = np.round(stored @ v, 6)
            if len(near) and near.max() > 0.95 or r["fact_text"] in seen:
                best = seen.get(r["fact_text"], list(serves)[int(near.argmax())] if len(near) else None)
                serves[best] += 1
            else:
                serves[doc * 10 + n] = 0
                seen[r["fact_text"]] = doc * 10 + n
                stored = np.vstack([stored, v])
    assert {r["fact_id"]: r["serve_count"] for r in rows(spark, small, "fact_merge")} == serves and max(serves.values()) > 0


def test_ivf_search(spark, small):
    """Its recall against brute force, on vectors of random directions."""
    items = pd.read_parquet(f"{small}/embeddings.parquet")
    unit = np.stack(items.embedding.to_list()).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = {q: {r["id"] for r in g} for q, g in groupby(sorted(rows(spark, small, "ivf_search"), key=lambda r: r["query_id"]), key=lambda r: r["query_id"])}
    hits = 0
    for at in np.flatnonzero(items.vec_id % 100 == 0):
        near = unit @ unit[at]
        near[at] = -9
        hits += len(got[items.vec_id[at]] & set(items.vec_id[np.argsort(-near)[:10]]))
    assert hits >= 0.9 * 10 * len(got) and all(len(g) == 10 for g in got.values())


def fill(parts, gap, gap_counts):
    """(parts, offset): as many parts as fit into 500 characters, the next begun with those of the end that fit into 50."""
    out, first, used, offset = [], 0, 0, 0
    for i, part in enumerate(parts):
        if i > first and used + len(part) + (gap if gap_counts else 0) > 500:
            out.append((parts[first:i], offset))
            start, kept = i, 0
            while start > first and kept + len(parts[start - 1]) <= 50:
                start -= 1
                kept += len(parts[start]) + gap
            first, used, offset = start, kept, offset + used - kept
        used += len(part) + gap
    return [*out, (parts[first:], offset)] if parts else out


def split_finer(text, separators):
    """Only the last group is split further, and the places of its parts are counted on from those that are already there."""
    if not separators:
        return []
    out, groups = [], fill(text.split(separators[0]), len(separators[0]), True)
    for n, (group, offset) in enumerate(groups):
        chunk = separators[0].join(group).strip()
        if n == len(groups) - 1 and len(chunk) > 500 and len(separators) > 1:
            for i, at, part in split_finer(chunk, separators[1:]):
                out.append((len(out) + i, offset + at, part))
        elif len(chunk) >= 50:
            out.append((len(out), offset, chunk))
    return out


def by_separators(text):
    if len(text) <= 500:
        return [(0, 0, text.strip())] if len(text.strip()) >= 50 else []
    return split_finer(text, ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " "])


def by_sentences(text):
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text) if not (text[m.start()] == "." and re.search(r"(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|Inc|Ltd|Corp)$", text[: m.start()]))]
    parts = [text[a:b].strip() for a, b in zip([0, *ends], [*ends, len(text)])]
    kept = [(offset, " ".join(g)) for g, offset in fill([p for p in parts if p], 1, False)]
    return [(n, at, c) for n, (at, c) in enumerate(x for x in kept if len(x[1]) >= 50)]


@pytest.mark.parametrize("name, chunks_of", [("chunk_recursive", by_separators), ("chunk_semantic", by_sentences)])
def test_chunks(spark, small, docs, name, chunks_of):
    """Every chunk, its place and its offset."""
    got = sorted((r["doc_id"], r["chunk_index"], r["char_offset"], r["chunk"]) for r in rows(spark, small, name))
    assert got == sorted((i, *c) for i, text in zip(docs.doc_id, docs.text) for c in chunks_of(text)) and got


def test_chunk_code(spark, small, docs):
    by = {k: sorted(g, key=lambda r: r["chunk_index"]) for k, g in groupby(sorted(rows(spark, small, "chunk_code"), key=lambda r: r["doc_id"]), key=lambda r: r["doc_id"])}
    for i, text in zip(docs.doc_id, docs.text):
        parts = re.split(r"[.]\s", text)
        lines = "\n".join(f"def f{n}(): # {x}" if n % 5 == 0 else x for n, x in enumerate(parts)).split("\n")
        chunks = by.get(i, [])
        assert not chunks or chunks[0]["first_line"] == 1 and chunks[-1]["last_line"] <= len(lines)
        for one, after in zip(chunks, [*chunks[1:], None]):
            body = lines[one["first_line"] - 1 : one["last_line"]]
            assert one["chunk"] == "\n".join(body) and len(body) <= 75
            names = [m[1] for x in body if (m := re.match(r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", x))]
            assert one["symbol"] == (names[0] if names else None)
            assert after is None or after["first_line"] == max(one["last_line"] - 9, one["first_line"] + 1)


def test_parse_html(spark, small):
    """By patterns that suffice for these pages: one heading, and its paragraphs, items and cells of over ten characters."""
    import html

    got = {k: list(g) for k, g in groupby(sorted(rows(spark, small, "parse_html"), key=lambda r: (r["page_id"], r["section"])), key=lambda r: r["page_id"])}
    squeeze = lambda s: " ".join(html.unescape(re.sub(r"<[^>]+>", "", s)).split())
    for page in pd.read_parquet(f"{small}/pages.parquet").itertuples():
        source = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "", page.html)
        title = squeeze(re.search(r"(?is)<title>(.*?)</title>", source)[1])
        source = re.sub(r"(?is)<title>.*?</title>", "", source)
        head, _, tail = source.partition("<h1>")
        heading, _, tail = tail.partition("</h1>")
        texts = lambda part: [t for t in (squeeze(x) for x in re.findall(r"(?is)<(?:p|li)>(.*?)(?=</?(?:p|li|h1)>|\Z)", part)) if len(t) > 10]  # noqa: E731, B023
        want = [(name, "\n\n".join(t)) for name, t in ((title, texts(head)), (squeeze(heading), texts(tail))) if t]
        assert [(r["title"], r["body"]) for r in got[page.page_id]] == want


def _all(pattern, text):
    return [m[0] for m in re.finditer(pattern, text)]


def test_narrative_names(spark, small, docs):
    got = {r["doc_id"]: r for r in rows(spark, small, "narrative_names")}
    for i, text in zip(docs.doc_id, docs.text):
        for kind in ("dates", "codes", "proper_nouns"):
            want = sorted(set(_all(R.FACTS[kind], text)))
            assert got[i][kind] == (want[:20] if kind == "proper_nouns" else want)


def test_tags_entities(spark, small, docs):
    got = {k: [(r["value"], r["confidence"]) for r in sorted(g, key=lambda r: r["position"])] for k, g in groupby(sorted(rows(spark, small, "tags_entities"), key=lambda r: r["doc_id"]), key=lambda r: r["doc_id"])}
    kinds = [(R.FACTS["citations"], 0.95), (R.DATES, 0.9), (R.FACTS["amounts"], 0.9), (R.FACTS["percentages"], 0.85), (r"\b[A-Z]{2}\b", 0.6), (r"(?<=\s)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", 0.7)]
    for i, text in zip(docs.doc_id, docs.text):
        found = {}
        for pattern, sure in kinds:
            for value in _all(pattern, text):
                if sure != 0.6 or value not in R.NO_JURISDICTION:
                    found.setdefault(value, sure)
        assert got.get(i, []) == list(found.items())[:30]


def test_atomic_fact_kinds(spark, small, docs):
    got = sorted((r["doc_id"], r["position"], r["entity"], r["category"], r["quality"]) for r in rows(spark, small, "atomic_fact_kinds"))
    want = []
    for i, text in zip(docs.doc_id, docs.text):
        for n, s in enumerate(re.split(r"(?<=[.!?])\s+", text.strip())):
            s = s.strip()
            if not 30 <= len(s) <= 500 or s.endswith("?") or re.match(rf"(?i)({R.FILLERS})\b", s):
                continue
            name = re.search(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", s) or re.search(r"\b([A-Z][A-Z0-9]{1,})\b", s)
            kind = next((k for k, p in R.CATEGORIES.items() if re.search(p, s, re.I)), "general")
            number = bool(re.search(r"(?i)\b\d+(?:\.\d+)?(?:%|\$|million|billion|percent)\b", s))
            quality = (0.5 if len(s) < 50 else 0.7) + 0.1 * bool(name) + 0.1 * number + 0.1 * (kind in ("definition", "rule"))
            want.append((i, n, name[1] if name else "", kind, round(min(0.9, quality), 2)))
    assert got == sorted(want)


def entities(q):
    found = [m[0][1:-1] for m in re.finditer(I.QUOTED, q)]
    found += [m[1] for p in (I.LINK, I.ADDRESS, I.PHRASE, I.QUANTITY) for m in re.finditer(p, q)]
    found += [m[1] for m in re.finditer(I.CODE, q) if len(m[1]) >= 3 and m[1] not in I.COMMON_CODES]
    return list(dict.fromkeys(x.strip(" ") for x in found if x.strip(" ")))


def test_intent_entities(spark, small):
    from larder.queries.q8_governance import OPENINGS

    turns = pd.read_parquet(f"{small}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["entities"] for r in rows(spark, small, "intent_entities")}
    assert got == {(t.conv_id, t.turn): entities(f"{OPENINGS[t.conv_id % 12]} {t.text}") for t in turns.itertuples()}


def test_extract_answers(spark, small, docs):
    texts = dict(zip(docs.doc_id, docs.text))
    best = {}
    for r in QUERIES["bm25_search"](spark, small).collect():  # which has SQL; its ten best are those of the twenty
        best.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    got = {r["query_id"]: r["extracted"] for r in rows(spark, small, "extract_answers")}
    assert got.keys() == best.keys()
    for q, found in best.items():
        want = list(dict.fromkeys(e for _, d in sorted(found) for e in entities(texts[d][:300])))[:50]
        assert (json.loads(got[q])["entities"] if got[q] else []) == want


COMPARES, NOISE = r"(?i)\b(?:compare|compared?\s+to|differences?\s+between|vs\.?|versus)\b", r"(?i)\b(?:how|does|do|what|are|is|the|for|in|and|or|between)\b"


def test_compared_items(spark, small):
    """The items by a plain loop; what sub-questions share holds none of them."""
    got = {k: sorted(g, key=lambda r: r["position"]) for k, g in groupby(sorted(rows(spark, small, "compared_items"), key=lambda r: r["question_id"]), key=lambda r: r["question_id"])}
    asked = list(exchanges(small))
    for one, after in zip(asked, [*asked[1:], None]):
        following = after[2] if after and after[1] == one[1] else "Something Else"
        q = f'Compare "{one[2]}" versus {following} in law?'
        want = {}
        pieces = re.findall('"([^"]+)"', q) + re.findall("'([^']+)'", q) + [re.sub("[?!.,]+", "", re.sub(NOISE, "", x)) for x in re.split(COMPARES, q)]
        for x in (x.strip(" ") for x in pieces):
            if len(x) >= 2:
                want.setdefault(x.lower(), x)
        items = list(want.values()) if len(want) >= 2 else []
        mine = got.get(one[0], [])
        assert [r["item"] for r in mine] == items
        assert all(r["sub_question"].startswith(r["item"]) for r in mine)


def test_corpus_variants(spark, small):
    asked = {i: q for i, _, q, _ in exchanges(small)}
    got = rows(spark, small, "corpus_variants")
    assert len(got) == 3 * len(asked)
    for r in got:
        q = asked[r["question_id"]]
        assert r["kind"] != "repeated" or r["variant"] == q
        assert r["kind"] != "typo" or sorted(r["variant"]) == sorted(q)
        assert r["kind"] != "paraphrased" or r["variant"] != q
