"""Joins by likeness and top-k search over written indexes, against plain versions and in their edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_plain import edits, fuzzy

from larder.operators import cells, postings
from larder.operators import fuzzy as Z


def words(rng, n, letters="abcé"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(n))


def test_fuzzy_matches(spark):
    rng = random.Random(3)
    stored = [(i, words(rng, rng.randint(0, 6))) for i in range(300)] + [(900, None), (901, ""), (902, "abca abca")]
    asks = [(i, words(rng, rng.randint(1, 4))) for i in range(60)] + [(70, ""), (71, None), (72, "the of"), (73, "a"), (74, "ab ac"), (75, "éa")]
    from larder.functions import text as T

    df = spark.createDataFrame(asks, "question_id long, question string")
    tokens = {r["question_id"]: r["t"] for r in df.select("question_id", T.tokens("question").alias("t")).collect()}
    want = []
    for i, _ in asks:
        longest = sorted(set(tokens[i] or []), key=lambda w: (-len(w), w))[:2]
        if not longest:
            continue
        known = [(j, s) for j, s in stored if s]
        found = [x for x in known if all(w in x[1] for w in longest)] or [x for x in known if longest[0] in x[1]]
        scored = sorted((-round(s, 6), j) for j, t in found if (s := fuzzy(" ".join(sorted(tokens[i])), t)) >= 0.3)
        want += [(i, j, -s, n) for n, (s, j) in enumerate(scored[:3], 1)]
    got = Z.matches(df, spark.createDataFrame(stored, "cache_id long, question_normalized string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
    assert Z.matches(df.limit(0), spark.createDataFrame(stored, "cache_id long, question_normalized string")).collect() == []


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_within_edits(spark, most):
    rng = random.Random(most)
    left = [(i, "".join(rng.choices("abé", k=rng.randint(0, 9)))) for i in range(150)] + [(200, None), (201, "")]
    right = [(i, "".join(rng.choices("abé", k=rng.randint(0, 9)))) for i in range(150)] + [(200, None), (201, ""), (202, "")]
    got = Z.within_edits(spark.createDataFrame(left, "left_id long, text string"), spark.createDataFrame(right, "right_id long, text string"), most)
    want = sorted((i, j, d) for i, a in left for j, b in right if a is not None and b is not None and (d := edits(a, b)) <= most)
    assert sorted(map(tuple, got.collect())) == want and want


def bm25(docs, asked, k, scope=None):
    from larder.functions.text import STOPWORDS

    split = {i: [w for w in t.split() if w not in STOPWORDS] for i, t in docs if t}
    split = {i: w for i, w in split.items() if w}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    df = Counter(w for ws in split.values() for w in set(ws))
    out, met = [], 0
    for q, text in asked:
        scored = []
        for i, ws in split.items():
            if scope is not None and i not in scope:
                continue
            tf = Counter(ws)
            shared = [w for w in set((text or "").split()) if w in tf and w not in STOPWORDS]
            met += bool(shared)
            if shared:
                scored.append((-round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in shared), 6), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out), met


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(600)] + [(700, None), (701, ""), (702, "the of")]
    asked = [(q, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 12)))) for q in range(40)] + [(50, None), (51, ""), (52, "unknown"), (53, "w399 w0")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return docs, asked, df, spark.createDataFrame(asked, "query_id long, text string"), postings.build(df)


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_postings_top(corpus, k):
    docs, asked, _, queries, index = corpus
    got = sorted(map(tuple, postings.top(index, queries, k).collect()))
    want, _ = bm25(docs, asked, k)
    assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


def test_postings_scope_and_count(spark, corpus):
    docs, asked, df, queries, index = corpus
    got = sorted((q, i, r) for q, i, _, r in map(tuple, postings.top(index, queries, 5, scope=df.where("doc_id % 7 = 2").select("doc_id")).collect()))
    assert got == [(q, i, r) for q, i, _, r in bm25(docs, asked, 5, {i for i, _ in docs if i % 7 == 2})[0]]
    counted = postings.top(index, queries, 5, counted=True).first()
    assert counted["met"] == bm25(docs, asked, 5)[1] and counted["scored"] < 0.25 * counted["met"]


def test_postings_every_term_and_phrases(corpus):
    docs, asked, df, queries, index = corpus
    terms = {q: set(t.split()) for q, t in asked if t}
    want = sorted((q, i) for q, ws in terms.items() for i, t in docs if t and ws <= set(t.split()))
    assert sorted((r["query_id"], r["doc_id"]) for r in postings.with_every_term(index, queries).collect()) == want and want
    got = {(r["query_id"], r["doc_id"]): r["tf"] for r in postings.phrases(index, df, queries).collect()}
    assert set(got) == {(q, i) for q, t in asked if t for i, d in docs if d and f" {t} " in f" {d} "} and got


def test_postings_of_nothing(spark, corpus):
    empty = postings.build(spark.createDataFrame([], "doc_id long, text string"))
    assert postings.top(empty, corpus[3]).collect() == [] and postings.top(corpus[4], corpus[3].limit(0)).collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(900)] + [(1000 + i, (centres[0] + 0.05 * rng.normal(size=16)).tolist()) for i in range(700)]  # one hot cell
    rows += [(5000, [0.0] * 16), (5001, [float("nan")] * 16), (5002, None)]
    unit = np.array([v for _, v in rows[:1600]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return rows, unit, spark.createDataFrame(rows, "id long, vector array<double>")


def test_index_reads_only_probed_cells(spark, vectors, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 64)
    rows, unit, df = vectors
    index = cells.build(df, cells=12)
    assert index.rows == 1600
    queries = df.where("id in (7, 19, 1003)").withColumnRenamed("id", "query_id")
    every = len(cells.stored(spark, index).inputFiles())
    read = []
    for probes in (1, 3, 12):
        got = cells.search(index, queries, probes, k=10)
        wanted = {r["cell"] for r in cells.probed(queries, index.centre, probes).select("cell").collect()}
        read.append(sum(f"cell={c}/" in f for c in wanted for f in cells.stored(spark, index).inputFiles()))
        near = {q: {r["id"] for r in got.collect() if r["query_id"] == q} for q in (7, 19, 1003)}
        ids = np.array([i for i, _ in rows[:1600]])
        hits = sum(len(near[q] & set(ids[np.argsort(-np.where(ids == q, -9, unit @ unit[np.flatnonzero(ids == q)[0]]))[:10]])) for q in near)
        assert hits >= (0.9 if probes > 1 else 0.6) * 30 and (probes < 12 or hits == 30)
    assert read[0] < read[1] < read[2] == every
    pruned = cells.stored(spark, index, [2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in pruned or "PartitionFilters: [(cell" in pruned


def test_index_grows(spark, vectors):
    _, _, df = vectors
    index = cells.build(df.where("id < 600"), cells=8)
    more = cells.add(index, df.where("id >= 600 and id < 700"))
    assert (more.built, more.rows, more.folder) == (600, 700, index.folder)
    again = cells.load(spark, more.folder)
    assert again.rows == 700 and np.allclose(again.centre, index.centre)
    rebuilt = cells.add(again, df.where("id >= 700"))
    assert rebuilt.folder != index.folder and rebuilt.built == rebuilt.rows == 1600
    ids = cells.stored(spark, rebuilt).selectExpr("explode(ids) AS id").collect()
    assert len({r["id"] for r in ids}) == len(ids) == 1600
    assert cells.search(cells.build(df.limit(0)), df.withColumnRenamed("id", "query_id")).collect() == []


@pytest.mark.parametrize("threshold", [0.2, 0.9, 0.99])
def test_similar(vectors, threshold, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 100)
    rows, unit, df = vectors
    got = cells.similar(df.where("id % 3 = 0").withColumnRenamed("id", "query_id"), df, threshold, cells=10).collect()
    ids = np.array([i for i, _ in rows[:1600]])
    near = unit[ids % 3 == 0] @ unit.T
    q, c = np.nonzero(near >= threshold)
    want = {(int(ids[ids % 3 == 0][a]), int(ids[b])) for a, b in zip(q, c) if ids[ids % 3 == 0][a] != ids[b]}
    assert len(got) == len(want) and {(r["query_id"], r["id"]) for r in got} == want


def test_similar_copies_few(spark, vectors):
    """At a high threshold a vector goes to few cells, so the work isn't that of all pairs."""
    _, _, df = vectors
    for threshold, most in ((0.99, 3.5), (0.95, 6)):
        centre = cells.centroids(df, 12, 3)
        mine = cells.assigned(df, centre).toPandas()
        radius, turn = mine.groupby("cell").angle.max(), math.acos(threshold)
        unit = np.stack(mine.vector)
        angles = np.arccos(np.clip(unit @ centre.T, -1, 1))
        reached = (angles <= np.array([radius.get(i, -9) for i in range(len(centre))]) + turn) & (angles <= angles.min(axis=1, keepdims=True) + 2 * turn)
        assert reached.sum() / len(mine) < most


def test_weighted_fields(spark):
    """A word in the title counts as its weight says; nulls, empty fields and rows without words are harmless."""
    rows = [(1, "red fox", "lake lake water"), (2, "stone", "red lake water"), (3, None, "red red red"), (4, "", None), (5, "red", "")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string")
    weights = {"title": 2.0, "body": 0.5}
    found = postings.build(docs, fields=weights)
    tf, lengths = defaultdict(float), defaultdict(float)
    for i, *texts in rows:
        for text, w in zip(texts, weights.values()):
            for word in (text or "").split():
                tf[word, i] += w
                lengths[i] += w
    mean = sum(lengths.values()) / len(lengths)
    asked = spark.createDataFrame([(7, "red lake"), (8, None), (9, "absent")], "query_id long, text string")
    want = {}
    for i in lengths:
        df = {t: sum(w == t for w, _ in tf) for t in ("red", "lake")}
        score = sum(math.log(1 + (len(lengths) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t, i] * 2.2 / (tf[t, i] + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for t in df if (t, i) in tf)
        want[7, i] = round(score, 6)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in postings.top(found, asked).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert {r["doc_id"] for r in postings.with_every_term(found, asked).collect()} == {1, 2}
    assert postings.top(postings.build(docs.limit(0), fields=weights), asked).collect() == []
