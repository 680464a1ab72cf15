"""Fused scores that are equal once rounded: the smaller id comes first, though another section is a little nearer."""

import math

import pytest

from larder.functions import vectors as V
from larder.operators import search as S


def _at(similarity):
    return [similarity, math.sqrt(1 - similarity**2)]


@pytest.mark.parametrize("parts", [1, 3])
def test_rounded_ties_go_by_id(spark, parts):
    rows = [(9, [_at(0.90001)]), (5, [_at(0.9)]), (7, [_at(0.8)]), (3, [_at(0.8995)]), (1, [[-1.0, 0.0]])]
    sections = spark.createDataFrame(rows, "id long, vectors array<array<double>>").repartition(parts)
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    none = spark.createDataFrame([], "query_id long, doc_id long, score double")
    for k, expected in ((1, [5]), (2, [5, 9]), (3, [5, 9, 3])):
        assert [r["doc_id"] for r in S.hybrid(none, queries, sections, k=k).orderBy("rank").collect()] == expected
    hit = spark.createDataFrame([(0, 3, 2.0)], "query_id long, doc_id long, score double")
    assert [r["doc_id"] for r in S.hybrid(hit, queries, sections, k=2).orderBy("rank").collect()] == [3, 5]


def test_copies_leave_a_batch_once(spark):
    """Of a thousand sections of one similarity a batch gives the k smallest ids, not all."""
    sections = spark.range(1000).selectExpr("id", "array(array(1.0D, 0.0D)) as vectors").coalesce(1)
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    found, _ = V.near_sections(queries, sections, 10, 0.1)
    assert sorted(r["id"] for r in found.collect()) == list(range(10))
