"""A Markdown text is cut once, not once for each of its sections."""

import re

from pyspark.sql import functions as F

from larder.sources import parsers as P


def test_text_is_cut_once(spark):
    rows = spark.createDataFrame([(1, "# a\nb\n## c\nd")], "id long, text string").select("id", F.concat("text", F.lit("\n")).alias("text"))
    plan = P.markdown_sections(rows, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bsplit\(", plan)) == 1


def test_many_headings(spark):
    """Ten thousand sections in one text; cutting it anew for each would take minutes."""
    rows = spark.createDataFrame([(1, "# h\nb\n" * 10_000)], "id long, text string")
    found = P.markdown_sections(rows, "id").agg(F.count("*").alias("n"), F.max("section").alias("last"), F.count_if((F.col("title") == "h") & (F.col("body") == "b")).alias("good")).first()
    assert tuple(found) == (10_000, 10_000, 10_000)
