"""Words listed from texts: what a listed word carries along, and texts without words."""

import re

import pytest

from larder.operators import postings as P

ROWS = [(1, "Red", "Blue sky", "red blue, red the"), (2, None, "", "sky"), (3, None, None, None), (4, "", "the of", " ,, ")]


@pytest.mark.parametrize("fields", [False, True])
def test_no_word_carries_its_text(spark, fields):
    """Else a text of n words is copied n times, which ended in a heap that was full."""
    docs = spark.createDataFrame(ROWS, "doc_id long, citation string, title string, text string")
    found = P.field_counts(docs, {"citation": 1.0, "title": 0.4, "text": 0.2}) if fields else P.term_counts(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    carried = [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"Generate posexplode\w*\(\w+#\d+\), \[([^\]]*)\]", plan)]
    assert carried and all(c <= {"key", "doc_length", "ends"} for c in carried)


def test_counts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, citation string, title string, text string")
    plain = {(r["key"], r["term"]): (r["doc_length"], r["tf"], r["at"]) for r in P.term_counts(docs).collect()}
    assert plain == {(1, "red"): (3, 2, 0), (1, "blue"): (3, 1, 1), (2, "sky"): (1, 1, 0)}
    found = {(r["key"], r["term"]): (round(r["doc_length"], 9), round(r["tf"], 9), r["at"]) for r in P.field_counts(docs, {"citation": 1.0, "title": 0.4, "text": 0.2}).collect()}
    assert found == {(1, "red"): (2.4, 1.4, 0), (1, "blue"): (2.4, 0.6, 1), (1, "sky"): (2.4, 0.4, 2), (2, "sky"): (0.2, 0.2, 0)}
