"""Words are counted within their row: nothing is shuffled for it, and empty and null rows give nothing."""

from collections import Counter

import pytest

from larder.functions.counts import ROWS
from larder.operators import postings as P
from larder.operators import rules as R


@pytest.mark.parametrize("kind", ["terms", "fields", "topics"])
def test_no_key_is_shuffled(spark, kind):
    docs = spark.createDataFrame([(1, "red blue red", "sky")], "doc_id long, text string, title string")
    found = {"terms": lambda: P.term_counts(docs), "fields": lambda: P.field_counts(docs, {"title": 1.0, "text": 0.2}), "topics": lambda: R.topics(docs, "doc_id")}[kind]()
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_counts_over_many_batches(spark):
    texts = {i: " ".join(f"w{j * i % 7}" for j in range(i % 5)) if i % 9 else None for i in range(2 * ROWS + 3)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    expected = {(i, w): (len(t.split()), n, t.split().index(w)) for i, t in texts.items() if t for w, n in Counter(t.split()).items()}
    assert {(r["key"], r["term"]): (r["doc_length"], r["tf"], r["at"]) for r in P.term_counts(docs).collect()} == expected


def test_topics_tie_by_place(spark):
    rows = [(1, "beta alpha alpha beta gamma gamma delta delta"), (2, "once only"), (3, None), (4, ""), (5, "zeta eta zeta eta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["topic"], r["n"], r["confidence"]) for r in R.topics(docs, "doc_id").collect()}
    assert found == {(1, "beta", 2, 0.5), (1, "alpha", 2, 0.5), (1, "gamma", 2, 0.5), (5, "zeta", 2, 0.5)}
