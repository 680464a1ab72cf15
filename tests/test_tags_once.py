"""Matches of a text are found once, not once for each of them; the first of equal values counts, 30 in all."""

import re

from pyspark.sql import functions as F

from larder.operators import rules as R

TEXT = "On 12 May 2020-01-02 New York paid $5 and 3%. see New York, OK GB 2020-01-02, at Old Town. 7%"


def test_patterns_run_once(spark):
    docs = spark.createDataFrame([(1, TEXT)], "id long, text string")
    plan = docs.select(R.entities(F.col("text")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract_all\(", plan)) == 6


def test_order_and_limit(spark):
    many = " ".join(f"x {i}%" for i in range(50))
    docs = spark.createDataFrame([(1, TEXT), (2, many), (3, ""), (4, None)], "id long, text string")
    found = {r["id"]: r["e"] for r in docs.select("id", R.entities(F.col("text")).alias("e")).collect()}
    assert [(e["value"], e["confidence"]) for e in found[1]] == [("2020-01-02", 0.9), ("$5", 0.9), ("3%", 0.85), ("7%", 0.85), ("OK", 0.6), ("GB", 0.6), ("New York", 0.7), ("Old Town", 0.7)]
    assert [e["value"] for e in found[2]] == [f"{i}%" for i in range(30)]
    assert found[3] == [] and found[4] is None
