"""The pipeline's near copies against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F

from larder.llm import jaccard, simhash


def _texts():
    """Groups of copies with words changed here and there, some around the bound; texts of a few words; a common passage."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    common = [rng.choice(words) for _ in range(30)]
    out = ["", "one", "one two", "one two three four five six"]
    for n in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(30, 150))] + common * (n % 3 == 0)
        out.append(" ".join(base))
        for changes in (1, 2, 3, 4):
            copy = list(base)
            for _ in range(max(1, len(copy) * changes // 150)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def _roots(texts, linked):
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if linked(a, b) and root[a] != root[b]:
                x, y = max(root[a], root[b]), min(root[a], root[b])
                root = [y if r == x else r for r in root]
    return root


def test_all_pairs_of_the_bound_are_united(spark, monkeypatch):
    """With small windows too, so that later rounds are needed."""
    texts = _texts()
    sets = [set(jaccard.shingle_set(t.encode(), 5).tolist()) for t in texts]
    expected = _roots(texts, lambda a, b: bool(sets[a]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    for window in (16, 4):
        monkeypatch.setattr(jaccard, "WINDOW", window)
        bound = Fraction(4, 5)
        got = jaccard.joined(rows, jaccard.sketches(rows, 5, bound), rows.select("row", F.col("row").alias("root")), 5, bound).collect()
        assert [r["root"] for r in sorted(got)] == expected
    assert len(set(expected)) < len(texts) - 40


def test_stage_leaves_no_similar_pair(spark, tmp_path):
    texts = _texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    kept = [r["text"] for r in simhash.keep_one_of_each(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()]
    sets = [set(jaccard.shingle_set(t.encode(), 5).tolist()) for t in kept]
    assert not [1 for i, x in enumerate(sets) for y in sets[:i] if x and y and 10 * len(x & y) >= 8 * len(x | y)]


def test_parities_rule_out_no_similar_pair():
    """The bound of differing parities never exceeds the number of shingles that only one of two sets has."""
    rng = np.random.default_rng(7)
    for n in (1, 5, 63, 64, 65, 200, 1000):
        for drop in (0.0, 0.05, 0.11, 0.3, 0.9):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) >= drop], rng.integers(0, 2**63, int(n * drop), dtype=np.uint64)]))
            if not len(y):
                continue
            sketch = np.empty(2, dtype=object)
            sketch[:] = [jaccard.parity(x), jaccard.parity(y)]
            close = jaccard._close(sketch, np.array([len(x), len(y)]), np.array([0]), np.array([1]), Fraction(4, 5))[0]
            both = len(np.intersect1d(x, y))
            assert close or 10 * both < 8 * (len(x) + len(y) - both)


def test_stage_keeps_columns_and_odd_rows(spark, tmp_path):
    rows = [(1, None, "a"), (2, None, "b"), (3, "", "c"), (4, "one two three", "d"), (5, "one two three", "e"), (5, "one two three", "e"), (None, "other words of its own here", "f")]
    spark.createDataFrame(rows, "doc_id long, text string, larder_row string").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    kept = simhash.keep_one_of_each(spark, docs, "").collect()
    assert sorted((r["text"] or "", r["larder_row"]) for r in kept) == [("", "a"), ("one two three", "d"), ("other words of its own here", "f")]
    assert simhash.keep_one_of_each(spark, docs.limit(0), "").collect() == []


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_only_rows(spark, monkeypatch, most):
    """By bits and by a join; ids of several partitions, and columns named like those it uses."""
    monkeypatch.setattr(jaccard, "BROADCAST", most)
    rows = jaccard.spill(spark.range(3000, numPartitions=5).select("id", F.lit(1).alias("_part"), F.lit(2).alias("_words"), F.monotonically_increasing_id().alias("row")))
    kept = rows.where("id % 7 = 0 or id > 2990").select("row")
    assert sorted(r["id"] for r in jaccard.only_rows(rows, kept, "row").collect()) == [i for i in range(3000) if i % 7 == 0 or i > 2990]
    assert jaccard.only_rows(rows, kept.limit(0), "row").collect() == [] and jaccard.only_rows(rows, kept, "row").columns == rows.columns
