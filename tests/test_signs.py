"""The cosine join by signs against all pairs."""

import numpy as np

from larder.operators import signs


def test_similar(spark):
    rng, rows = np.random.default_rng(3), []
    for size in (1, 4, 9, 12, 18, 25, 33, 45):  # words: from no loose place to many
        base = np.zeros(64)
        np.add.at(base, rng.integers(0, 64, size), rng.choice([-1.0, 1.0], size))
        for _ in range(6):
            near = base.copy()
            near[rng.integers(0, 64)] += rng.choice([-1.0, 0.0, 1.0])
            rows.append(near * rng.integers(1, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "query_id long, vector array<double>")
    unit = np.array([v / max(np.linalg.norm(v), 1e-10) for v in rows])
    near = np.round(unit @ unit.T, 6)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(near > 0.95), strict=True) if i != j}
    got = [(r["query_id"], r["id"]) for r in signs.similar(df, df.withColumnRenamed("query_id", "id"), 0.95).where("similarity > 0.95").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_alone_and_wide(spark):
    """The pairs of one table alone and of two, of vectors over 64 places, of which some have many small numbers or one large one; two tables that share rows."""
    rng, rows = np.random.default_rng(5), []
    for size in (1, 2, 3, 8, 15, 22, 30, 44, 60, 90):
        base = np.zeros(100)
        np.add.at(base, rng.integers(0, 100, size), rng.choice([-1.0, 1.0], size))
        base[rng.integers(0, 100)] += rng.choice([0.0, 0.0, 4.0, 12.0])
        for _ in range(8):
            near = base.copy()
            near[rng.integers(0, 100, 2)] += rng.choice([-1.0, 0.0, 1.0], 2)
            rows.append(near + (rng.normal(0, 0.01, 100) if rng.random() < 0.2 else 0))
    unit = np.array([v / max(np.linalg.norm(v), 1e-10) for v in rows])
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.round(unit @ unit.T, 6) > 0.95), strict=True) if i != j}
    df = signs.signed(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, vector array<double>"), 0.95)
    assert {r["tier"] for r in df.select("tier").distinct().collect()} > {0, 1, len(signs.TIERS)}
    got = [(r["query_id"], r["id"]) for r in signs.near_pairs(df, None, 0.95).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in want if i > j} and len(want) > 100
    got = [(r["query_id"], r["id"]) for r in signs.near_pairs(df.where("id < 60"), df.where("id >= 40"), 0.95).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in want if i < 60 and j >= 40}


def test_few_are_multiplied(spark, small, monkeypatch):
    """Of the facts of a table few meet all others: pairs of vectors that are multiplied as blocks, against all pairs."""
    from pyspark.sql import functions as F

    from larder.functions.vectors import hashed_embedding
    from larder.operators import rules

    met = []
    if hasattr(signs, "_multiplied"):  # as it was: blocks of two arrays
        multiplied = signs._multiplied
        monkeypatch.setattr(signs, "_multiplied", lambda df, *more: met.append(df.agg(F.sum(F.size("asked") * F.size("ids"))).first()[0] or 0) or multiplied(df, *more))
    else:
        with_all = signs._with_all
        monkeypatch.setattr(signs, "_with_all", lambda wide, others, near: met.append(wide.count() * others.count()) or with_all(wide, others, near))
    texts = rules.atomic_facts(spark.read.parquet(f"{small}/documents.parquet"), "doc_id", "text").select("fact_text").distinct()
    facts = texts.select(F.xxhash64("fact_text").alias("query_id"), hashed_embedding(F.col("fact_text")).alias("vector"))
    n = facts.count()
    signs.similar(facts, facts.withColumnRenamed("query_id", "id"), 0.95).count()
    assert n > 500 and sum(met) < n * n / 30
